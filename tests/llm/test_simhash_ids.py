"""SimHash with ids of any value."""

from __future__ import annotations

from lamella.llm import simhash


def test_ids_of_any_value(spark):
    text = "a quite unlike document number {} about {} and nothing else of {} at all"
    own = [1, 1 << 62, (1 << 62) + 5, (1 << 63) - 1, -(1 << 63), 0, None]
    rows = [(i, " ".join(text.format(f"w{n}{k}", f"x{n}{k}", f"y{n}{k}") for k in range(9))) for n, i in enumerate(own)]
    rows += [((1 << 63) - 2, rows[3][1]), (None, rows[4][1]), (None, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    expected = [(i, i) for i in own if i != (1 << 63) - 1] + [((1 << 63) - 1, (1 << 63) - 2), ((1 << 63) - 2, (1 << 63) - 2), (None, -(1 << 63)), (None, None)]
    assert found == sorted(expected, key=str)
    kept = sorted((r["doc_id"] for r in simhash.deduplicate(docs).collect()), key=str)
    assert kept == sorted([1, 1 << 62, (1 << 62) + 5, (1 << 63) - 2, -(1 << 63), 0, None], key=str)
