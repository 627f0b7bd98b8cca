"""Secrets within longer runs, broadcasts by their bytes, masks without copies, and what a pipeline leaves."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from test_llm import brute_hits, local, same, texts  # noqa: F401

import corpus_pipeline
from lamella.llm import decontaminate, secrets, token_files
from lamella.llm._common import fresh_path, shared_dir

BASE62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
PLACES = ("see {} here", "https://api.example.com/v1/users/account/{}", "get https://example.org/download/releases/file/{} now", "deployment-production-service-account-credential_{}", "/usr/local/share/application/config/{}", "session-identifier={}")


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("length", [20, 32])
def test_keys_within_longer_runs_are_found(place, length):
    rng, encoding, found = random.Random(length), secrets.loaded(secrets.DEFAULT_VOCABULARY), 0
    for _ in range(300):
        key = "".join(rng.choices(BASE62, k=length))
        text = place.format(key).encode()
        at = text.index(key.encode())
        base = secrets.base_spans(text)
        covered = {p for s, _, e in base + secrets.random_spans(text, base, encoding) for p in range(s, e)}
        found += set(range(at, at + length)) <= covered
    assert found >= 0.9 * 300


def brute_spans(text, base, encoding):
    """Every stretch of key characters without the base's places: itself, or else its parts between separators."""
    allowed = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
    runs = lambda held: [(s, e) for s in range(len(text)) for e in [next((k for k in range(s, len(text) + 1) if k == len(text) or not held(k)), s)] if e - s >= secrets.LEAST_RUN and held(s) and (s == 0 or not held(s - 1))]
    long = set()  # the base's spans cut runs only where a run was long enough
    for s, e in runs(lambda k: text[k] in allowed):
        long |= set(range(s, e))
    free = lambda k: k in long and not any(s <= k < e for s, _, e in base)
    rate = lambda x: len(x) / len(encoding.encode_ordinary(x.decode()))
    out = []
    for s, e in runs(free):
        if secrets._known(text[s:e]):
            continue
        if rate(text[s:e]) <= secrets.MOST_CHARS_A_TOKEN:
            out.append((s, 3, e))
        else:
            out += [(a, 3, b) for a, b in runs(lambda k, s=s, e=e: s <= k < e and text[k] not in b"/=_-") if (a, b) != (s, e) and not secrets._known(text[a:b]) and rate(text[a:b]) <= secrets.MOST_CHARS_A_TOKEN]
    return out


def test_token_spans_against_brute_force():
    rng, encoding = random.Random(3), secrets.loaded(secrets.DEFAULT_VOCABULARY)
    bits = ["deployment", "production", "-", "_", "/", "=", " ", "\n", "0123456789abcdef", "password=", "é", "2024-01-01"]
    for _ in range(300):
        text = "".join(rng.choice(bits) if rng.random() < 0.75 else "".join(rng.choices(BASE62, k=rng.randint(5, 40))) for _ in range(12)).encode()
        base = secrets.base_spans(text)
        assert secrets.random_spans(text, base, encoding) == brute_spans(text, base, encoding), text


def test_one_gram_in_very_many_items_is_not_broadcast(spark, monkeypatch):
    """The bound counts the ids in a row: one phrase in 20,000 items is one row of 300 kB and more."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 100_000)
    phrase = "one two three four five six seven eight nine ten"
    items = spark.range(20_000).selectExpr("concat('item-', id) as item_id", f"'{phrase}' as text")
    docs = spark.createDataFrame([(1, f"so {phrase} it is"), (2, "nothing of this kind")], "doc_id bigint, text string")
    found = decontaminate.report(docs, items)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found.collect()} == {1: (10, 20_000), 2: (0, 0)}


def test_masks_are_views(spark):
    docs = spark.createDataFrame([(i, "some words to be held " * (i + 1)) for i in range(20)], "doc_id bigint, text string")
    folder = fresh_path(spark, "test-masks")
    token_files.write(docs, folder, length=16, rows=4)
    shard = token_files.Shard(folder, 0)
    n = sum(shard.tokens.get_batch(k).num_rows for k in range(shard.tokens.num_record_batches))
    for s in range(n):
        ids, mask = shard.sequence(s)
        assert not ids.flags.owndata and not mask.flags.owndata and np.shares_memory(mask, shard._both)
        assert mask.tolist() == shard.mask_bits(s).to_pylist() and len(ids) == 16
    assert mask.sum() < 16 or n * 16 == sum(r["n_tokens"] for r in token_files.read_index(spark, spark.read.json(f"{folder}/_manifest"), folder).collect())


def test_a_pipeline_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 10
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and next(iter(left)).startswith("lamella-pipeline-bpe")
