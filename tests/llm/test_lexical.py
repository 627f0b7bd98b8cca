"""Ranked search: index, blocks and ranks against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import docs, empty, local  # noqa: F401

from lamella.llm import lexical

ITEMS = [("a", "The of étion 12"), ("b", "nothing-here zzzz"), ("c", None), ("d", "x x x THE abc w60 w61"), (None, "übEr naïve 日本語"), ("a", "token"), ("d", "x x x THE abc w60 w61")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def brute(rows, items, k=lexical.K):
    """(item_id, rank, doc_id, score) of every distinct item."""
    counts = [(i, Counter(terms(t or ""))) for i, t in rows]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text or "")) if t in df}
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_against_brute_force(docs, spark, parts):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = lexical.search(lexical.index(docs.repartition(parts)), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute(local(docs), ITEMS)


def test_items_in_parts_and_ids_of_strings(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_ITEMS", 3)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    rng = random.Random(5)
    words = [f"w{min(99, int(rng.expovariate(0.05)))}" for _ in range(6000)]
    rows = [(f"d{i:03}", " ".join(words[20 * i : 20 * i + rng.randint(0, 20)])) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(20)]
    found = lexical.search(lexical.index(spark.createDataFrame(rows, "doc_id string, text string")), spark.createDataFrame(items, "item_id bigint, text string"), k=4)
    assert Counter(map(tuple, found.collect())) == brute(rows, items, 4)


def test_empty_tables(docs, spark):  # noqa: F811
    none = spark.createDataFrame([], "item_id string, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical.search(lexical.index(docs), none).collect() == []
    assert lexical.search(lexical.index(empty(spark)), items).collect() == []


def test_blocks_have_the_least_bound_error(monkeypatch):
    rng = np.random.default_rng(1)
    impacts = rng.integers(1, 1000, 150)
    starts = np.array([0, 1, 40])
    docs_ = np.concatenate([np.sort(rng.permutation(300)[:n]) for n in (1, 39, 110)])
    begin = lexical.blocks(starts, docs_, impacts)
    for a, b in ((0, 1), (1, 40), (40, 150)):
        x, d = impacts[a:b], docs_[a:b]
        cost = lexical.BLOCK_COST * x.mean()
        least = [0.0]
        for j in range(1, len(x) + 1):
            least.append(min(least[i] + (d[j - 1] + 1 - d[i]) * x[i:j].max() - x[i:j].sum() + cost for i in range(max(0, j - lexical.MOST_BLOCK), j)))
        own = [i - a for i in begin if a <= i < b]
        assert own[0] == 0
        assert sum((d[j - 1] + 1 - d[i]) * x[i:j].max() - x[i:j].sum() + cost for i, j in zip(own, [*own[1:], b - a], strict=True)) == pytest.approx(least[-1])
    many = np.arange(0, 50_000, 10)
    whole = lexical.blocks(many, np.tile(np.arange(10), 5000), np.tile(impacts[:10], 5000))
    monkeypatch.setattr(lexical, "CELLS", 1)
    assert (lexical.blocks(many[:50], np.tile(np.arange(10), 50), np.tile(impacts[:10], 50)) == whole[whole < 500]).all()


def test_search_of_a_segment_skips_blocks_and_is_exact():
    rng = np.random.default_rng(2)
    n = 5000
    lengths = rng.integers(50, 500, n).astype("<i4")
    held = [np.flatnonzero(rng.random(n) < p) for p in (0.7, 0.5, 0.3, 0.05, 0.01, 0.001)]
    tfs = [np.minimum(rng.geometric(0.4, len(d)), 50).astype("<i4") for d in held]
    gaps = [np.diff(d, prepend=0).astype("<i4") for d in held]
    lists = lexical.Lists(lengths, [g.tobytes() for g in gaps], [t.tobytes() for t in tfs], n, int(lengths.sum()))
    weights = np.array([300, 600, 1200, 3000, 4500, 6500])
    scores = np.zeros(n, dtype=np.int64)
    for d, t, w in zip(held, tfs, weights, strict=True):
        m = 10 + 90 * lengths[d].astype(np.int64) * n // int(lengths.sum())
        scores[d] += w * (1_000_000_000 * t.astype(np.int64) // (1000 * t.astype(np.int64) + 8 * m))
    expected = np.lexsort((np.arange(n), -scores))[:10]
    docs_, values = lists.best(np.arange(6), weights, 10)
    assert docs_.tolist() == expected.tolist() and values.tolist() == scores[expected].tolist()
    assert lists.opened < 0.5 * len(lists.begin)
