"""Ranked lexical search by variable-block-max WAND over an index in segments.

The index. Each task cuts the rows that it reads into segments (at most SEGMENT_DOCS documents and about SEGMENT_POSTINGS postings),
numbers a segment's documents by ascending id, and writes a row for each of its terms, with the documents that hold the term (gaps)
and its occurrences in each, and one row for the segment's documents, with ids and lengths. Nothing is shuffled; every term of every
row is indexed. Counts of the corpus (documents, terms, documents with a term) are sums over these rows.

The search. Items are dealt into parts of about PART_ITEMS. Terms of items, with weights, are joined to the index by term (broadcast
behind a check of their size, else by a shuffle), and what meets is grouped by segment and part. In such a group a dynamic program
cuts each posting list into blocks that minimise the bound error, the sum over the documents in a block's range of its largest impact
less their own (0 where they lack the term), plus a fixed cost a block. Blocks of an item's lists give each range of documents an upper bound; ranges are scored from the highest
bound on, opening just the blocks that reach into them, until a bound is below the k-th best score so far. So the k best of a
segment are exact, and the k best of all follow from them. A search's group holds one segment, whatever the corpus holds.

A term's weight is floor(1000 ln((2N + 2) / (2df + 1))), its impact in a document (10^9 tf) div (1000 tf + 8m), m = 10 + (90 n N) div L,
and the score the sum of weight x impact over the item's terms, once each.

Defined results: a null or empty text has no terms; such documents don't count in N, and such items have no rows. Equal scores are
in order of ascending id, null ids last; repeated rows are documents of their own, each of which counts and may be found; of repeated
items with one text, one is answered, and items of one id with other texts each have ranks of their own (told apart by 64-bit hashes).
Empty tables give no rows; other columns are not read. A very long text is one row of one task, and a segment ends with it.
"""

from __future__ import annotations

from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm._common import cut, row_key, spread, written

K = 10
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 1_000_000
PART_ITEMS = 2048
BROADCAST_BYTES = 64 << 20
#: Lists beyond PIECE postings are cut into equal pieces first, over which the dynamic program runs side by side; a block has at most
#: MOST_BLOCK postings, and costs as much as BLOCK_COST mean impacts.
PIECE, MOST_BLOCK, BLOCK_COST = 512, 64, 4.0
CELLS = 4_000_000
#: Documents in the first ranges that are scored, and how much more each further step takes.
FIRST_DOCS, STEP = 64, 4

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


# ---- the index


class _Segment:
    """Documents of a segment as they come, and their rows for the index."""

    def __init__(self):
        self.ids, self.lengths, self.sizes, self.terms, self.tfs = [], [], [], [], []

    def add(self, text: str | None) -> None:
        words = terms_of(text)
        counts = Counter(words)
        self.lengths.append(len(words))
        self.sizes.append(len(counts))
        self.terms.extend(counts)
        self.tfs.extend(counts.values())

    def full(self) -> bool:
        return len(self.lengths) >= SEGMENT_DOCS or len(self.terms) >= SEGMENT_POSTINGS

    def batches(self, segment: int, schema: pa.Schema):
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        none = lambda kind, n: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), none(pa.string(), 1), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), none(pa.binary(), 1), pa.array([lengths.astype("<i4").tobytes()], pa.binary()), one], schema=schema)
        if not self.terms:
            return
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.view(pa.string())
        docs, tfs = number[np.repeat(np.arange(len(number)), self.sizes)], np.array(self.tfs, dtype="<i4")
        place = np.lexsort((docs, codes))
        codes, docs, tfs = codes[place], docs[place], tfs[place]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        gaps = np.concatenate(([0], docs[:-1]))
        gaps[starts] = 0
        gaps = (docs - gaps).astype("<i4")
        dfs = np.diff(np.append(starts, len(codes)))
        edges = pa.py_buffer((4 * np.append(starts, len(codes))).astype("<i4").tobytes())
        packed = [pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, edges, pa.py_buffer(x.tobytes())]) for x in (gaps, tfs)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), segment)), names, pa.array(dfs.astype(np.int64)), pa.array(np.add.reduceat(tfs, starts).astype(np.int64)), *packed, none(schema.field("ids").type, len(starts))], schema=schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of every row, a written table. Of a term: segment, term, df, total (occurrences), gaps and tfs. Of a segment's
    documents: segment, no term, df (documents with terms), total (terms), their lengths as tfs, and ids."""

    def run(batches):
        base, numbers, held, schema = TaskContext.get().partitionId() << 24, count(), _Segment(), None
        for b in cut(batches, 1):
            if schema is None:
                schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("gaps", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(b.column(0).type))])
            start = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                held.add(text)
                if held.full():
                    held.ids.append(b.column(0).slice(start, i + 1 - start))
                    yield from held.batches(base + next(numbers), schema)
                    held, start = _Segment(), i + 1
            if start < b.num_rows:
                held.ids.append(b.column(0).slice(start))
        if held.lengths:
            yield from held.batches(base + next(numbers), schema)

    kind = docs.schema[id_col].dataType.simpleString()
    return written(spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"segment bigint, term string, df bigint, total bigint, gaps binary, tfs binary, ids array<{kind}>"), "index")


# ---- blocks


def blocks(starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Where blocks of posting lists begin (lists begin at starts), by the least bound error and BLOCK_COST a block."""
    sizes = np.diff(np.append(starts, len(impacts)))
    pieces = -(-sizes // PIECE)
    which = np.repeat(np.arange(len(starts)), pieces)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[which] + sizes[which] * k // pieces[which]
    length = starts[which] + sizes[which] * (k + 1) // pieces[which] - first
    order = np.argsort(-length, kind="stable")
    cost = BLOCK_COST * (np.add.reduceat(impacts, starts) / sizes)[which]
    found, at = [], 0
    while at < len(order):
        group = order[at : at + max(1, CELLS // (int(length[order[at]]) + 2 * MOST_BLOCK))]
        found.append(_cuts(first[group], length[group], cost[group], docs, impacts))
        at += len(group)
    return np.sort(np.concatenate(found))


def _cuts(first: np.ndarray, length: np.ndarray, cost: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """The beginnings of the blocks of pieces, of falling length."""
    most = int(length[0])
    # least[p, j + MOST_BLOCK]: the least sum of widths of blocks x their maxima, and of costs, over the first j postings of a piece
    least = np.full((len(first), most + 1 + MOST_BLOCK), np.inf)
    least[:, MOST_BLOCK] = 0
    chosen = np.zeros((len(first), most + 1), dtype=np.int16)
    largest, low = np.zeros((2, len(first), MOST_BLOCK))  # [p, l - 1]: of the last l postings
    active = len(first)
    for j in range(1, most + 1):
        while length[active - 1] < j:
            active -= 1
        value, doc = (x[first[:active] + j - 1].astype(np.float64)[:, None] for x in (impacts, docs))
        largest[:active, 1:] = np.maximum(largest[:active, :-1], value)
        largest[:active, :1] = value
        low[:active, 1:] = low[:active, :-1]
        low[:active, :1] = doc
        ways = least[:active, j : j + MOST_BLOCK][:, ::-1] + largest[:active] * (doc + 1 - low[:active])
        best = ways.argmin(axis=1)
        chosen[:active, j] = best + 1
        least[:active, j + MOST_BLOCK] = ways[np.arange(active), best] + cost[:active]
    found, p, j = [], np.arange(len(first)), length.copy()
    while len(p):
        j = j - chosen[p, j]
        found.append(first[p] + j)
        p, j = p[j > 0], j[j > 0]
    return np.concatenate(found)


class Lists:
    """The posting lists of a segment, in blocks."""

    def __init__(self, lengths: np.ndarray, gaps: list[bytes], tfs: list[bytes], n_docs: int, n_terms: int):
        sizes = np.array([len(x) // 4 for x in gaps])
        self.starts = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(gaps), dtype="<i4").astype(np.int64)
        total = np.cumsum(every)
        self.docs = total - np.repeat(total[self.starts] - every[self.starts], sizes)
        tf = np.frombuffer(b"".join(tfs), dtype="<i4").astype(np.int64)
        m = 10 + 90 * lengths.astype(np.int64) * n_docs // n_terms
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.n = len(lengths)
        self.begin = blocks(self.starts, self.docs, self.impacts)
        self.stop = np.append(self.begin[1:], len(self.docs))
        self.largest = np.maximum.reduceat(self.impacts, self.begin)
        self.low, self.high = self.docs[self.begin], self.docs[self.stop - 1] + 1
        edge = np.searchsorted(self.begin, np.append(self.starts, len(self.docs)))
        self.first_block, self.block_count = edge[:-1], np.diff(edge)
        self.opened = 0

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of an item whose terms have the lists rows, and their scores; equal ones by rising number."""
        n = self.block_count[rows]
        b = np.repeat(self.first_block[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weight = np.repeat(weights, n)
        edges, place = np.unique(np.concatenate((self.low[b], self.high[b])), return_inverse=True)
        begin, end = place[: len(b)], place[len(b) :]
        step = np.zeros(len(edges), dtype=np.int64)
        np.add.at(step, begin, weight * self.largest[b])
        np.subtract.at(step, end, weight * self.largest[b])
        bounds, widths = np.cumsum(step)[:-1], np.diff(edges)
        order = np.argsort(-bounds, kind="stable")
        falling, covered = -bounds[order], np.cumsum(widths[order])
        scores, docs, values, at, wanted = np.zeros(self.n, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, FIRST_DOCS
        while at < len(order):
            least = max(1, int(values[-1])) if len(values) == k else 1
            stop = min(int(np.searchsorted(falling, -least, side="right")), int(np.searchsorted(covered, (covered[at - 1] if at else 0) + wanted)) + 1)
            if stop <= at:
                break
            taken = np.zeros(len(edges), dtype=bool)
            taken[order[at:stop]] = True
            reach = np.concatenate(([0], np.cumsum(taken)))
            open_ = np.flatnonzero(reach[end] > reach[begin])
            sizes = self.stop[b[open_]] - self.begin[b[open_]]
            self.opened += len(open_)
            p = np.repeat(self.begin[b[open_]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            d = self.docs[p]
            inside = np.repeat(taken[:-1], widths)[d - edges[0]]
            d = d[inside]
            np.add.at(scores, d, (np.repeat(weight[open_], sizes) * self.impacts[p])[inside])
            new = np.unique(d)
            new = new[scores[new] >= least]
            docs, values = np.concatenate((docs, new)), np.concatenate((values, scores[new]))
            kept = np.lexsort((docs, -values))[:k]
            docs, values = docs[kept], values[kept]
            at, wanted = stop, wanted * STEP
        return docs, values


# ---- the search


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term), each once, of (item, text)."""

    def run(batches):
        for b in cut(batches, 1):
            found = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))), pa.array([t for f in found for t in f], pa.binary()).view(pa.string())], names=["item", "term"])

    return items.mapInArrow(run, "item bigint, term string")


def search(indexed: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """item_col, rank, id_col and score: the k best documents of an index for every item that has any."""
    spark = items.sparkSession
    asked = written(items.select(row_key(item_col, text_col).alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).dropDuplicates(["item"]), "asked")
    parts = -(-max(1, asked.count()) // PART_ITEMS)
    terms = written(_item_terms(asked.select("item", "text")).groupBy(F.pmod("item", F.lit(parts)).cast("int").alias("part"), "term").agg(F.collect_list("item").alias("items")), "terms")
    size = terms.agg(F.sum(F.length("term") + 8 * F.size("items") + 64)).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    stats = indexed.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    n_docs, n_terms = (int(x or 0) for x in stats)
    of_terms = indexed.where("term is not null")
    dfs = of_terms.select("term", "df").join(near(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighted = written(terms.join(dfs, "term").select("part", "term", "items", weight.alias("weight")), "weighted")
    met = of_terms.select("segment", "term", "gaps", "tfs").join(near(weighted), "term").select("segment", "part", "gaps", "tfs", "weight", "items", F.lit(None).cast(indexed.schema["ids"].dataType).alias("ids"))
    about = indexed.where("term is null").select("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("binary").alias("gaps"), "tfs", F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("array<bigint>").alias("items"), "ids")
    kind = indexed.schema["ids"].dataType.elementType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        names = ["item", "id", "score"]
        about = table.filter(pc.is_null(table.column("gaps")))
        rows = table.filter(pc.is_valid(table.column("gaps")))
        ids = about.column("ids").combine_chunks().flatten()
        if not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), ids.slice(0, 0), pa.array([], pa.int64())], names=names)
        lists = Lists(np.frombuffer(about.column("tfs")[0].as_py(), dtype="<i4"), rows.column("gaps").to_pylist(), rows.column("tfs").to_pylist(), n_docs, n_terms)
        weights = rows.column("weight").to_numpy()
        of = rows.column("items").combine_chunks()
        item, row = of.flatten().to_numpy(), pc.list_parent_indices(of).to_numpy()
        order = np.argsort(item, kind="stable")
        item, row = item[order], row[order]
        edges = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        found = [(item[a], *lists.best(row[a:b], weights[row[a:b]], k)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        docs = np.concatenate([f[1] for f in found])
        return pa.Table.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), ids.take(pa.array(docs)), pa.array(np.concatenate([f[2] for f in found]))], names=names)

    best = met.unionByName(about).groupBy("segment", "part").applyInArrow(run, f"item bigint, id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


#: The same rows in DuckDB's SQL, over all terms.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY r, term),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, whole GROUP BY term, n_docs),
doc AS (SELECT r, doc_id, (10 + (90 * len(w)::BIGINT * n_docs) // n_terms)::BIGINT AS m FROM d, whole WHERE len(w) > 0),
score AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN doc USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
