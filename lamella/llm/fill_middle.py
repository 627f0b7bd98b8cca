"""Fill-in-the-middle transformation over an index of the distinct texts.

Texts with equal SHA-256 digests are grouped by their content (a grouping by digest and text, with partial sums, so a third of
all rows with one text costs one row a task). Each distinct text gets, once, the list of the byte offsets at which its units
(code points, or words) begin, in Elias-Fano form: the upper parts of the offsets in unary, the lower bits as they are, a few bits
a unit. Documents are joined back to the lists by digest; a document's seeded cuts are then two selections in its text's list,
without another look at the text. Should two texts have one digest, their documents are cut on lists of their own.

A document is cut into prefix, middle and suffix after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) of its n units;
h1 to h4 are the first four 8-digit groups of the hex SHA-256 of the seed, a colon and the id. Forms: `psm` <P>prefix<S>suffix<M>middle,
`spm` <S>suffix<P>prefix<M>middle, and `plain`, the text as it is.

Defined results: a null text is as an empty one, and an empty one is plain; so is a text that holds a sentinel, which makes `restore`
exact. A null id has the hash of the seed and the colon alone. Repeated rows have equal results, rows of one id with other texts
their own; an empty table gives no rows; other columns are not read. A very long text is one row of one task, and its list takes
about two bits a unit beyond its bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import cut, spread, written

SEED, FORMED_PERCENT, SPM_PERCENT = 1, 90, 20
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: _NTH[byte, k]: the place of the k-th set bit of a byte.
_NTH = np.array([[*np.flatnonzero(np.unpackbits(np.uint8(v), bitorder="little")), *[8] * 8][:8] for v in range(256)], dtype=np.int64)


def boundaries(text: bytes, units: str = "chars") -> np.ndarray:
    """The byte offsets at which units begin. The first word begins at 0, and a word takes the white space behind it."""
    if units == "chars":
        return np.flatnonzero(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)
    starts = [m.start() for m in _WORD.finditer(text)]
    return np.array([0, *starts[1:]] if text else [], dtype=np.int64)


def low_bits(n: int, size: int) -> int:
    return max(0, (size // n).bit_length() - 1) if n else 0


class EliasFano:
    """A rising list of n numbers under size: unary upper parts and packed lower bits."""

    def __init__(self, n: int, size: int, high: bytes, low: bytes):
        self.n, self.size, self.high, self.low, self.bits = n, size, high, low, low_bits(n, size)
        self.ones = None

    @classmethod
    def of(cls, values: np.ndarray, size: int) -> EliasFano:
        n, bits = len(values), low_bits(len(values), size)
        marks = np.zeros(n + (size >> bits) + 1, dtype=np.uint8)
        marks[(values >> bits) + np.arange(n)] = 1
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        return cls(n, size, np.packbits(marks, bitorder="little").tobytes(), np.packbits(low, bitorder="little").tobytes())

    def __getitem__(self, i: int) -> int:
        """The i-th number; size for i = n, the end of the last unit."""
        if i >= self.n:
            return self.size
        high = np.frombuffer(self.high, dtype=np.uint8)
        if self.ones is None:
            self.ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        at = int(np.searchsorted(self.ones, i, side="right"))
        before = int(self.ones[at - 1]) if at else 0
        upper = 8 * at + int(_NTH[high[at], i - before]) - i
        lower = 0
        for k in range(self.bits):
            p = i * self.bits + k
            lower |= (self.low[p >> 3] >> (p & 7) & 1) << k
        return upper << self.bits | lower


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_index(docs: DataFrame, text_col: str = "text", units: str = "chars") -> DataFrame:
    """(key, n, size, high, low) of each distinct text; a written table. Two rows of one key are two texts of one digest."""
    if units not in UNITS:
        raise ValueError(f"units are one of {UNITS}")

    def run(batches):
        for b in cut(batches, 1):
            lists = [EliasFano.of(boundaries(t, units), len(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.n for x in lists], pa.int64()), pa.array([x.size for x in lists], pa.int64()), pa.array([x.high for x in lists], pa.binary()), pa.array([x.low for x in lists], pa.binary())], names=["key", "n", "size", "high", "low"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = spread(docs.select(_key(text).alias("key"), text.alias("text"))).distinct()
    return written(distinct.select("key", F.col("text").cast("binary")).mapInArrow(run, "key binary, n bigint, size bigint, high binary, low binary"), "texts")


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, units: str = "chars", formed_percent: int = FORMED_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars (null if plain) and output of every row."""
    index = text_index(docs, text_col, units)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    own = spread(docs.select(F.col(id_col).alias("id"), text.alias("text"), _key(text).alias("key"), digest.alias("h")))
    clash = index.groupBy("key").count().where("count > 1").select("key")
    if clash.isEmpty():
        listed = own.join(index, "key")
    else:  # texts of one digest, of which no two are known: their documents make lists of their own
        clash = written(clash, "clash")
        none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("n", "size", "high", "low")]
        listed = own.join(clash, "key", "left_anti").join(index, "key").unionByName(own.join(clash, "key", "left_semi").select("*", *none))
    whole = F.lit(False)
    for s in SENTINELS:
        whole = whole | F.contains("text", F.lit(s))
    form = F.when(whole | (F.col("text") == "") | (_number(F.col("h"), 2) % 100 >= formed_percent), "plain").when(_number(F.col("h"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    ready = listed.select("id", F.col("text").cast("binary").alias("text"), _number(F.col("h"), 0).alias("a"), _number(F.col("h"), 1).alias("b"), form.alias("form"), "n", "size", "high", "low")
    p, s, m = (x.encode() for x in SENTINELS)

    def run(batches):
        for batch in cut(batches, 1):
            columns = [c.to_pylist() for c in batch.columns[1:]]
            counts, before, inside, outputs = [], [], [], []
            for t, a, b, form, n, size, high, low in zip(*columns, strict=True):
                places = EliasFano.of(boundaries(t, units), len(t)) if n is None else EliasFano(n, size, high, low)
                counts.append(places.n)
                if form == "plain":
                    before.append(None)
                    inside.append(None)
                    outputs.append(t)
                    continue
                a, b = sorted((a % (places.n + 1), b % (places.n + 1)))
                i, j = places[a], places[b]
                start, middle, end = t[:i], t[i:j], t[j:]
                before.append(a if units == "chars" else len(start.decode()))
                inside.append(b - a if units == "chars" else len(middle.decode()))
                outputs.append(p + start + s + end + m + middle if form == "psm" else s + end + p + start + m + middle)
            outputs = pa.array(outputs, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(4), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), outputs], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ready.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: between its sentinels there are no others."""
    part = F.split(output, "|".join(SENTINELS), -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digests(formed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `transform` with the SHA-256 digests of the output and of the text rebuilt from it, in place of the output."""
    again = restored(F.col("form"), F.col("output"))
    return formed.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


#: The same rows in DuckDB's SQL, by substrings.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256,
  sha256(x || y || z) AS restored_sha256
FROM p
"""
