"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Of every WINDOW consecutive hashes of K-word grams the least is kept (the last of equal ones), in documents and in
benchmark items alike. A span of K + WINDOW - 1 = 10 shared words has the same grams on both sides and so the same kept
one, which guarantees that the join of kept hashes meets every such span. A meeting is extended by words to both sides,
up to the ends of the ten-word windows around it, and counts if ten words agree; so 32-bit hashes that collide cost a
comparison and change nothing. Items of fewer words are grams of their own length, with windows of one.

Documents aren't shuffled: one pass makes a row per document and a row per kept hash, and only rows that meet an item
go on to the grouping by document. The items' side is broadcast while its counted size (rows, and the ids of all items in each) is under BROADCAST_BYTES, and
joined by a shuffle beyond it (kept hashes then carry the few words around them).

Defined results: a null text has no words; documents and items without words have no hits; items with a null id mark
words, but aren't listed; of repeated items each id is listed; repeated documents give a row each, and documents that
share an id are told apart by their texts; empty tables give no rows, or no hits; a very long text is one row of one task; other columns are not read, and
`remove` hands them on, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import free_name, row_key, spread, written

LENGTH, K = 10, 5
WINDOW = LENGTH - K + 1
SIDE = LENGTH - K
BROADCAST_BYTES = 64 << 20
BYTES_A_ROW = 400
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 31) - 1


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _range(n: Column) -> Column:
    """0 to n - 1; none for n under 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int) -> Column:
    """A 32-bit hash of every gram above its negated place, so that the least of equal hashes is the last."""

    def one(i: Column) -> Column:
        h = F.xxhash64(F.lit(length), *(F.get(hashes, i + j) for j in range(length)))
        return F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR((F.lit(LAST) - i).cast("bigint"))

    return F.transform(_range(F.size(hashes) - (length - 1)), one)


def _kept(grams: Column) -> Column:
    """The least of every WINDOW grams, each once."""
    return F.array_distinct(F.transform(_range(F.size(grams) - (WINDOW - 1)), lambda i: F.least(*(F.get(grams, i + j) for j in range(WINDOW)))))



def _place(kept: Column) -> Column:
    return (F.lit(LAST) - kept.bitwiseAND(F.lit(LAST))).cast("int")


def _around(hashes: Column, place: Column) -> Column:
    return F.transform(F.sequence(place - SIDE, place + LENGTH - 1), lambda p: F.when(p >= 0, F.get(hashes, p)))


def _hashes(df: DataFrame, columns: list[Column], text_col: str) -> DataFrame:
    """columns, hashes of the words, and kept: each step is a projection of its own, as an array that a function of its
    elements reads must be made once, not for each element."""
    words = df.select(*columns, words_of(F.col(text_col)).alias("words"))
    names = [c for c in words.columns if c != "words"]
    hashes = words.select(*names, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    grams = hashes.select(*names, "hashes", _grams(F.col("hashes"), K).alias("grams"))
    return grams.select(*names, "hashes", _kept(F.col("grams")).alias("kept"))


# explode_outer in what follows: for explode, Spark would infer a filter on the array's size and push it down to where the
# array's expression is worked out anew for each element.


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(h, length, around, items) of the items' kept hashes, one row for those of equal surroundings; the lengths of items that
    are shorter than a window."""
    items = _hashes(benchmark, [F.col(item_col).alias("item")], text_col)
    size = F.size("hashes")
    lengths = sorted(r[0] for r in items.select(size.alias("n")).where(f"n between 1 and {LENGTH - 1}").distinct().collect())
    long = items.select("item", "hashes", F.lit(LENGTH).alias("length"), F.explode_outer("kept").alias("kept"))
    for n in lengths:
        long = long.union(items.where(size == n).select("item", "hashes", F.lit(n), F.explode_outer(_grams(F.col("hashes"), n))))
    long = long.where(F.col("kept").isNotNull())
    place = _place(F.col("kept"))
    grams = long.select(F.shiftright("kept", 31).alias("h"), "length", "item", _around(F.col("hashes"), place).alias("around"))
    return written(grams.groupBy("h", "length", "around").agg(F.collect_set("item").alias("items")), "items"), lengths


def _run(at, length: Column, around: Column) -> tuple[Column, Column, Column]:
    """Whether the words meet; words of the meeting before and after the start of the gram. at(j): the document's j-th word from there."""
    equal = {j: F.coalesce(at(j) == F.get(around, F.lit(j + SIDE)), F.lit(False)) for j in range(-SIDE, LENGTH)}

    def steps(offsets: list[int]) -> Column:
        out = F.lit(len(offsets))
        for n in reversed(range(len(offsets))):
            out = F.when(~equal[offsets[n]], F.lit(n)).otherwise(out)
        return out

    before, after = steps([-j for j in range(1, SIDE + 1)]), K + steps(list(range(K, LENGTH)))
    core = reduce(and_, (equal[j] for j in range(K)))
    short = reduce(and_, (equal[j] | (length <= j) for j in range(LENGTH)))
    is_long = length == LENGTH
    return F.when(is_long, core & (before + after >= LENGTH)).otherwise(short), F.when(is_long, before).otherwise(0), F.when(is_long, after).otherwise(length)


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(id, row, copies, n_words, spans, items), one row for equal documents."""
    items, lengths = _items(benchmark, item_col, item_text_col)
    ids = F.aggregate("items", F.lit(0).cast("bigint"), lambda n, i: n + 24 + F.octet_length(i.cast("string")))
    small = (items.agg(F.sum(ids + BYTES_A_ROW)).first()[0] or 0) <= BROADCAST_BYTES
    texts = spread(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")))
    own = _hashes(texts, [F.col("id"), F.col("row")], "text")

    def tagged(kept: Column, length: int) -> Column:
        return F.transform(kept, lambda v: F.struct(v.alias("kept"), F.lit(length).alias("length"))) if lengths else kept

    kept = [tagged(F.col("kept"), LENGTH), *(tagged(_grams(F.col("hashes"), n), n) for n in lengths)]
    mark = F.array(F.struct(F.lit(-1).cast("bigint").alias("kept"), F.lit(0).alias("length")) if lengths else F.lit(-1).cast("bigint"))
    rows = own.select("id", "row", "hashes", F.size("hashes").alias("n_words"), F.explode_outer(F.concat(mark, *kept)).alias("x"))
    nowhere = -1 - F.col("row").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))  # equal to no item's hash, and another for each document
    value, length = (F.col("x.kept"), F.col("x.length")) if lengths else (F.col("x"), F.lit(LENGTH))
    rows = rows.select("id", "row", "n_words", value.alias("kept"), length.alias("doc_length"), "hashes", F.when(value >= 0, F.shiftright(value, 31)).otherwise(nowhere).alias("dh"), _place(value).alias("place"))
    same = (F.col("dh") == F.col("h")) & (F.col("doc_length") == F.col("length")) if lengths else F.col("dh") == F.col("h")
    if small:
        # the array of a document is handed on by reference as far as the join, and read only where a hash meets
        met = rows.join(F.broadcast(items), same, "left").where((F.col("kept") < 0) | F.col("h").isNotNull())
        at = lambda j: F.when(F.col("place") + j >= 0, F.get(F.col("hashes"), F.col("place") + j))
    else:
        carried = rows.withColumn("near", F.when(F.col("kept") >= 0, _around(F.col("hashes"), F.col("place")))).drop("hashes")
        met = carried.join(items.hint("merge"), same, "left").where((F.col("kept") < 0) | F.col("h").isNotNull())
        at = lambda j: F.get(F.col("near"), F.lit(j + SIDE))
    meets, before, after = _run(at, F.col("length"), F.col("around"))
    found = met.select("id", "row", "n_words", F.when(F.col("kept") < 0, 1).alias("copy"), F.when(F.col("kept") >= 0, meets).alias("meets"), F.struct((F.col("place") - before).alias("start"), (F.col("place") + after).alias("stop")).alias("span"), "items")
    found = found.where(F.col("copy").isNotNull() | F.col("meets"))
    hit = F.col("copy").isNull()
    return found.groupBy("id", "row").agg(F.sum("copy").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set(F.when(hit, F.col("span"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words in shared spans), spans (start, stop in words), n_items, items_sha256, contaminated."""
    hits = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    # overlapping spans repeat places, so places are made distinct
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1))))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = hits.select(F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), F.size(places).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.col("spans"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that share a span with an item."""
    gone = written(_hits(docs, benchmark, id_col, text_col, item_col, item_text_col).where(F.size("spans") > 0).select("id", "row"), "contaminated")
    row = free_name(docs, "lm_row")
    keyed = docs.withColumn(row, row_key(id_col, text_col)).alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.id")) & (F.col(f"d.`{row}`") == F.col("x.row"))
    return keyed.join(gone.alias("x"), same, "left_anti").select(*docs.columns)


#: The same rows in DuckDB's SQL, by plain windows, over whole tables.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), item AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), size AS (SELECT DISTINCT n FROM item
), win AS (
  SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, size WHERE len(w) >= n)
), hit AS (SELECT DISTINCT r, i, win.n, item_id FROM win JOIN item ON win.n = item.n AND win.win = item.win
), place AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (r) LEFT JOIN items USING (r)
"""
