"""Personal data: base patterns against plain ones, candidates against enumeration, the model on held-out texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import docs, empty, local, same, sha  # noqa: F401

from lamella.llm import boosting, pii
from lamella.llm.pii_examples import examples

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(d):
    return sum(int(x) for k, c in enumerate(d[::-1]) for x in str(int(c) * (1 + k % 2))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and brute_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def odd_texts():
    rng = random.Random(8)
    bits = ["a.b@c.de", "@", "é@x.y", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0000255.1.2", "4845 1681 1440-7329", "4845168114407329", "1", "0", " ", "+", "+1 (171) 555-7209", "-", ".", "日本", "a", "%", "(487) 555-7209", "x (at) y (dot) com", "::1:ab:", "DE89370400440532013000", "\n", "2353820953013749 4550997810720808"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(800)]


def test_base_against_plain_patterns():
    for text in odd_texts():
        assert sorted(pii.base_spans(text.encode())) == [(len(text[:s].encode()), k, len(text[:e].encode())) for s, k, e in brute(text)], text


def test_scan(docs, spark):  # noqa: F811
    texts_ = odd_texts()[:300]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts_)], "doc_id bigint, text string"))
    found = pii.scan(rows)
    expected = []
    for i, text in local(rows):
        base = brute(text)
        count = Counter(k for _, k, _ in base)
        expected.append((i, *(count[k] for k in range(4)), sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base))))
    same(found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect(), expected)
    base = Counter((i, f"{pii.KINDS[k]}:{s}:{e}") for i, t in local(rows) for s, k, e in brute(t))
    spans = Counter((r["doc_id"], x) for r in found.collect() for x in r["spans"].split(",") if x)
    assert not base - spans and sum((spans - base).values()) == found.agg({"n_added": "sum"}).first()[0] > 20
    assert pii.scan(empty(spark)).collect() == []


def test_accepted_spans_against_brute_force():
    """Added spans are, over all candidates, those that pass in order of their probability and touch neither base nor each other."""
    model = pii.default_model()
    texts_ = [t.encode() for t in odd_texts()[:300]] + [t.encode() for t, _ in examples(300, 5)]
    bases = [pii.base_spans(t) for t in texts_]
    for text, base, found in zip(texts_, bases, pii.accepted(texts_, bases, model), strict=True):
        pool = [c for c in pii.candidates(text) if not any(s < c[2] and c[0] < e for s, _, e in base)]
        scored = []
        for c in pool:
            x = np.array([pii.features(text, text.lower(), *c)])
            scored.append((c, float(model.chances(x, np.array([c[1]]))[0])))
        kept = []
        for c, p in sorted(scored, key=lambda x: (-x[1], x[0][0] - x[0][2], x[0][0], x[0][1])):
            if p >= model.limits.get(c[1], 2) and not any(k[0] < c[2] and c[0] < k[2] for k in kept):
                kept.append(c)
        assert sorted(kept) == [f[:3] for f in found]


def test_held_out_accuracy_of_each_kind():
    model, right, wrong, missed = pii.default_model(), Counter(), Counter(), Counter()
    rows = examples(4000, 99)
    texts_ = [t.encode() for t, _ in rows]
    bases = [pii.base_spans(t) for t in texts_]
    for (text, spans), base, found in zip(rows, bases, pii.accepted(texts_, bases, model), strict=True):
        true = {(len(text[:s].encode()), pii.KINDS.index(k), len(text[:e].encode())) for s, e, k in spans}
        true = {x for x in true if not any(s < x[2] and x[0] < e for s, _, e in base)}
        got = {f[:3] for f in found}
        right.update(k for _, k, _ in got & true)
        wrong.update(k for _, k, _ in got - true)
        missed.update(k for _, k, _ in true - got)
    for k in range(pii.BASE, len(pii.KINDS)):
        assert right[k] > 100 and right[k] / (right[k] + wrong[k]) > 0.95 and right[k] / (right[k] + missed[k]) > 0.93, (pii.KINDS[k], right[k], wrong[k], missed[k])


def test_boosting_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    y[rng.random(4000) < 0.05] = 0
    trees = boosting.Boosted().fit(x[:3000], y[:3000])
    margins = trees.margins(x[3000:])
    assert ((margins > 0) == y[3000:]).mean() > 0.93 and len(trees.margins(x[:0])) == 0
    curve = boosting.isotonic(margins, y[3000:])
    assert (np.diff(curve[0]) > 0).all() and (np.diff(curve[1]) > 0).all()
    chances = boosting.probability(curve, margins)
    assert abs(chances.mean() - y[3000:].mean()) < 1e-9
    t = boosting.threshold(chances, y[3000:], 0.9)
    assert y[3000:][chances >= t].mean() >= 0.9 and boosting.threshold(chances, 0 * y[3000:], 0.9) > 1


def test_redact(spark):
    rows = spark.createDataFrame([(1, "Ä write to joe@x.org or call (487) 555-7209 now, 12.5.2020"), (2, None), (3, "nothing 300.1.2.400")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["redacted"] for r in pii.redact(rows).collect()} == {1: "Ä write to [EMAIL] or call [LOCAL_PHONE] now, 12.5.2020", 2: "", 3: "nothing 300.1.2.400"}


@pytest.mark.parametrize("bit", ["a", "1", "1 ", "@", "a@", "1.", "+1", "a at b ", ":1:", "DE12 ", "(1)", "+1 (171) 555-7209 "])
def test_long_texts_take_linear_time(bit):
    import time

    model, took = pii.default_model(), []
    for n in (60_000, 240_000):
        text = (bit * n)[:n].encode()
        began = time.perf_counter()
        pii.accepted([text], [pii.base_spans(text)], model)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1
