"""Line dedup: lines found in many documents go from all of them.

Lines are exploded as (document, position, 128-bit hash of the normalised line); documents are counted per hash with
partial sums, each document counting once, so a line that a third of all documents share costs one row per task; hashes
at the threshold are joined back to the positions, and documents reassembled without those. Line texts aren't
shuffled; a document's text is, once, to meet its positions.

Defined results: null and empty texts are one empty line, which has no key and so stays (a null text comes back as the
empty string); every row is a document of its own in the counts, repeated rows too; rows that share an id are told
apart by their texts; other columns aren't touched, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import cut, free_name, freed, row_key, written

SPACES = b" \t\n\v\f\r"
BY_DOCUMENT = 10
LEAST_KEY = 1


def normalised(text: str) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z in lower case."""
    return [line.strip(SPACES) for line in text.encode().lower().split(b"\n")]  # lower() of bytes changes A-Z alone


def _lines(docs: DataFrame, id_col: str, text_col: str, least_key: int) -> DataFrame:
    """(id, row, at, key, first) of every line with a key; first: the document has no earlier line of that key."""

    def run(batches):
        freed()
        for b in cut(batches, 2):
            owner, at, keys, first = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                seen = set()
                for k, key in enumerate(normalised(text or "")):
                    if len(key) >= least_key and (least_key <= 1 or len(key.decode()) >= least_key):
                        h = xxhash.xxh3_128_digest(key)
                        owner.append(i)
                        at.append(k)
                        keys.append(h)
                        first.append(h not in seen)
                        seen.add(h)
            which = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(at, pa.int32()), pa.array(keys, pa.binary()), pa.array(first, pa.bool_())], names=["id", "row", "at", "key", "first"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), row_key(id_col, text_col), F.col(text_col)).mapInArrow(run, f"id {kind}, row bigint, at int, key binary, first boolean")


def _drops(docs: DataFrame, id_col: str, text_col: str, by_document: int, least_key: int) -> DataFrame:
    """(id, row, drop): the positions that go, for documents with such lines."""
    lines = written(_lines(docs, id_col, text_col, least_key), "lines")
    # written, so that the join below sees two plain inputs, whose large partitions Spark can split
    common = written(lines.where("first").groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= by_document).select("key"), "common")
    hit = lines.select("id", "row", "at", "key").join(common, "key")
    return hit.groupBy("id", "row").agg(F.collect_set("at").alias("drop"))


def _with_drops(docs: DataFrame, id_col: str, text_col: str, by_document: int, least_key: int) -> tuple[DataFrame, str]:
    drops = _drops(docs, id_col, text_col, by_document, least_key)
    row, drop = free_name(docs, "lm_row"), free_name(docs, "lm_drop")
    keyed, found = docs.withColumn(row, row_key(id_col, text_col)).alias("d"), drops.alias("x")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.id")) & (F.col(f"d.`{row}`") == F.col("x.row"))
    joined = keyed.join(found, same, "left")
    return joined.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("x.drop").alias(drop)), drop


def reassembled(text: str, drop: list[int] | None) -> tuple[str, int, int]:
    """The text without the lines at those positions; lines before; lines dropped."""
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    gone = set(drop)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_document: int = BY_DOCUMENT, least_key: int = LEAST_KEY, chars_col: str | None = None) -> DataFrame:
    """docs with the texts that are left; chars_col: a column that gets their lengths."""
    joined, drop = _with_drops(docs, id_col, text_col, by_document, least_key)
    text, at = docs.columns.index(text_col), len(docs.columns)
    chars = docs.columns.index(chars_col) if chars_col else None
    names = docs.columns

    def run(batches):
        freed()
        for b in cut(batches, text):
            left = [reassembled(t or "", d)[0] for t, d in zip(b.column(text).to_pylist(), b.column(at).to_pylist())]
            columns = [b.column(i) for i in range(len(names))]
            columns[text] = pa.array(left, pa.string())
            if chars is not None:
                columns[chars] = pa.array(list(map(len, left)), pa.int64()).cast(b.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_document: int = BY_DOCUMENT, least_key: int = LEAST_KEY) -> DataFrame:
    """id_col, n_lines, n_dropped and kept_sha256 of every document."""
    joined, drop = _with_drops(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, by_document, least_key)

    def run(batches):
        freed()
        for b in batches:
            made = [reassembled(t or "", d) for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([hashlib.sha256(m[0].encode()).hexdigest() for m in made], pa.string())], names=[id_col, "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


#: The same rows in DuckDB's SQL, over whole tables.
ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, rowid_ AS r, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents)
), line AS (
  SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), flagged AS (
  SELECT doc_id, r, pos, line, key IN (SELECT key FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id, r
"""
