"""Fill-in-the-middle: lists of boundaries, cuts against brute force, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_llm import docs, empty, local, same, sha  # noqa: F401

from lamella.llm import fill_middle


@pytest.mark.parametrize("spread", [1, 2, 3, 9, 1000])
def test_elias_fano_selects_every_number(spread):
    rng = np.random.default_rng(spread)
    values = np.unique(rng.integers(0, 500 * spread, 500))
    made = fill_middle.EliasFano.of(values, 500 * spread)
    assert [made[i] for i in range(len(values))] == values.tolist() and made[len(values)] == 500 * spread
    assert len(made.high) + len(made.low) <= len(values) * (2 + fill_middle.low_bits(len(values), 500 * spread)) // 8 + 100
    none = fill_middle.EliasFano.of(np.zeros(0, dtype=np.int64), 0)
    assert none[0] == 0


def brute(i, text, seed=1):
    h = [int(sha(f"{seed}:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return (i, n, "spm" if spm else "psm", a, b - a, sha(f"<S>{z}<P>{x}<M>{y}" if spm else f"<P>{x}<S>{z}<M>{y}"), sha(text))


def test_cuts_against_brute_force(docs, spark):  # noqa: F811
    same(fill_middle.digests(fill_middle.transform(docs)).collect(), [brute(i, t) for i, t in local(docs)])
    assert fill_middle.transform(empty(spark)).collect() == []


def test_copies_share_a_list_and_have_cuts_of_their_own(spark):
    texts = ["die Größe 日本 𝄞 x" * 5, "<P>held", "a<", "<", "P>S>M>", "a<S", "\0<M"]
    rows = spark.createDataFrame([(i, texts[i % 7]) for i in range(700)], "doc_id bigint, text string")
    assert fill_middle.text_index(rows).count() == 7
    found = fill_middle.digests(fill_middle.transform(rows))
    same(found.collect(), [brute(i, texts[i % 7]) for i in range(700)])
    assert found.where("form = 'plain'").count() > 100 and found.select("prefix_chars").distinct().count() > 30


def test_words_as_units(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ä", "bb", "ccc\n", "\t"], k=rng.randint(1, 30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fill_middle.transform(rows, units="words").withColumn("again", fill_middle.restored(fill_middle.F.col("form"), fill_middle.F.col("output"))).collect():
        text = texts[r["doc_id"]]
        assert r["again"] == text and r["n"] == max(1, len(text.split()))
        if r["form"] != "plain":
            ends = [r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]]
            assert all(e in (0, len(text)) or (text[e - 1].isspace() and not text[e].isspace()) for e in ends)


def test_texts_of_one_digest_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "_key", lambda text: fill_middle.F.unhex(fill_middle.F.hex(fill_middle.F.length(text) % 3)))
    texts = ["abc", "äöüé", "x" * 10, "日本語 is", "a", "bb"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    same(fill_middle.digests(fill_middle.transform(rows)).collect(), [brute(i, t) for i, t in enumerate(texts)])
