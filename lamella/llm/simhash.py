"""SimHash near-dedup over a Gray-order hierarchical index.

A text's word shingles are hashed, and a fingerprint's bit is set where over half of the hashes have it. Equal
fingerprints are joined by a grouped minimum first, so copies cost one row. Distinct fingerprints are dealt into
buckets of which any two linked ones share at least one:

- exact linking: the bits are cut into blocks, and a bucket is the value of all blocks but as many as bits may differ
  (two fingerprints that differ in no more bits agree in all the blocks without a difference). The number of blocks
  grows with the number of fingerprints, so that buckets stay small;
- banded linking, for wide fingerprints and many differing bits: a bucket is the value of a table's sample of bits. Samples and
  tables grow with the number of fingerprints, too.

In a bucket, fingerprints are sorted by Gray rank, so neighbours share many bits; each run of SPAN is a leaf node, each
run of SPAN nodes an upper node, and a node keeps the bits that all below it share (a mask and their values). A query
goes down from the top, and a whole node is pruned once the differences under its mask are more than the limit, or once
all below it are already linked with the query. Buckets much above the mean are dealt into salted parts, and each pair
of parts is a task's group, so no task gets a whole hot bucket and no link is lost. Only links to the least member of
what a group has joined leave it, at most one a row; a component search over them does the rest.

Defined results: a null text is as an empty one: no words, fingerprint zero, linked as any other. Ids are integers of any value; rows
with a null id link as others do, but have no id to give, and their component is null if it holds no other id. Repeated
rows have equal fingerprints and so one component. An empty table gives no rows. A very long text is one row of one task. Other columns are not read, and
`deduplicate` hands them on, whatever their names.
"""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import cut, discard, free_name, freed, row_key, spread, written
from lamella.llm.graph import components

SEED = 42
SHINGLE, MOST_BITS = 4, 4
SPAN = 16
BUCKET = 4096
HOT_LEAST, HOT_TIMES = 1024, 4
#: Pairs looked at in one step of the search, about 100 bytes each.
PAIRS = 200_000
GROUP_ROWS = 60_000
#: The wide fingerprints of `deduplicate`: 64-bit words, tables, bits of a table's sample. Their angle tells the
#: similarity of shingle sets: see `bits_for`.
WIDE, TABLES, SAMPLE = 4, 32, 16
DEDUP_SHINGLE, DEDUP_SIMILARITY = 5, 0.8

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def bits_for(similarity: float, bits: int) -> int:
    """How many of so many bits differ, in the mean, between sets of that Jaccard similarity and equal size."""
    cosine = 2 * similarity / (1 + similarity)
    return round(bits * float(np.arccos(cosine)) / np.pi)


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the word shingles, A-Z in lower case, words joined by a space; fewer words: of all of them."""
    words = text.encode().lower().split()  # of bytes: A-Z alone changes, \x20 and \x09-\x0D part words
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    return list(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, ends)), repeat(SEED)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash that follows from h; the first is h itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint(hashes: list[int], words: int, repeats: bool) -> bytes:
    """words x 64 bits, most significant first; bit i of word k is set where over half of the k-th hashes have it."""
    h = np.array(hashes, dtype=np.uint64)
    if not repeats:
        h = np.unique(h)
    out = b""
    for k in range(words):
        columns = _mixed(h, k).astype("<u8").view(np.uint8).reshape(-1, 8)
        value = 0
        for byte in range(8):
            ones = np.bincount(columns[:, byte], minlength=256) @ _BITS
            value |= sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()) << 8 * byte
        out += int(value).to_bytes(8, "big")
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1, repeats: bool = True) -> DataFrame:
    """(id, row, fp): the fingerprint of every whole text, as bytes."""

    def run(batches):
        freed()
        for b in cut(batches, 2):
            fp = [fingerprint(h, words, repeats) if (h := shingle_hashes(t or "", shingle)) else b"\0" * 8 * words for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.binary())], names=["id", "row", "fp"])

    return spread(docs.select(F.col(id_col).cast("bigint"), row_key(id_col, text_col), F.col(text_col))).mapInArrow(run, "id bigint, row bigint, fp binary")


# ---- buckets


def blocks_for(count: int, most_bits: int) -> int:
    """Blocks of 64 bits such that a bucket of evenly spread fingerprints has at most BUCKET of so many."""
    blocks = most_bits + 1
    while blocks < 32 and count > BUCKET << (64 * (blocks - most_bits) // blocks):
        blocks += 1
    return blocks


def exact_masks(blocks: int, most_bits: int) -> list[list[int]]:
    """For each bucket table the positions of its bits: all blocks but most_bits of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [[p for i in kept for p in range(edges[i], edges[i + 1])] for kept in itertools.combinations(range(blocks), blocks - most_bits)]


def tables_for(count: int, words: int, most_bits: int, tables: int, sample: int) -> tuple[int, int]:
    """Tables and bits of a sample for so many fingerprints: as given while buckets of evenly spread ones hold BUCKET at most; beyond
    that a bit more for each doubling, and so many more tables that a pair of most_bits differing bits is found as often."""
    bits = max(sample, (max(1, count) // BUCKET).bit_length())
    agree = 1 - most_bits / (64 * words)
    return round(tables * agree ** (sample - bits)), bits


def sampled_masks(words: int, tables: int, sample: int) -> list[list[int]]:
    """For each bucket table the positions of its sample of bits, fixed by the parameters."""
    rng = np.random.default_rng(SEED)
    out: list[list[int]] = []
    while len(out) < tables:  # tables of one permutation share no bit
        order = rng.permutation(64 * words)
        out += [sorted(order[i : i + sample].tolist()) for i in range(0, 64 * words - sample + 1, sample)]
    return out[:tables]


def bucket_of(fps: np.ndarray, table: int, positions: list[int]) -> np.ndarray:
    """The bucket of each fingerprint (rows of 64-bit words) in a table, as one number; keys above 47 bits are mixed."""
    key = np.zeros(len(fps), dtype=np.uint64)
    for n, p in enumerate(positions):
        bit = (fps[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        if n and n % 47 == 0:
            key = _mixed(key, 1) & np.uint64((1 << 47) - 1)
        key = (key << np.uint64(1) | bit) & np.uint64((1 << 47) - 1)
    return (key | np.uint64(table) << np.uint64(47)).view(np.int64)


def _as_words(column: pa.Array, words: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=">u8").astype(np.uint64).reshape(-1, words)


def _buckets(distinct: DataFrame, words: int, masks: list[list[int]]) -> DataFrame:
    def run(batches):
        freed()
        for b in batches:
            fps = _as_words(b.column(1), words)
            for t, positions in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(fps, t, positions)), b.column(0), b.column(1)], names=["bucket", "node", "fp"])

    return distinct.select("node", "fp").mapInArrow(run, "bucket bigint, node bigint, fp binary")


# ---- the index


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The rank of each fingerprint in Gray order, as words that compare from the first on."""
    out, odd = fps.copy(), np.zeros(len(fps), dtype=bool)
    for k in range(fps.shape[1]):
        w = out[:, k]
        for s in (1, 2, 4, 8, 16, 32):
            w ^= w >> np.uint64(s)
        w[odd] = ~w[odd]
        odd = (w & np.uint64(1)).astype(bool)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Hierarchical indexes of many groups at once: rows are sorted by group, then by Gray rank."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.group, self.fps = group, fps
        # levels[0] are rows; a node of level i spans nodes first[i][v] to first[i][v + 1] of level i - 1
        self.first, self.shared, self.value, self.owner = [None], [None], [None], [group]
        low, high = fps, fps
        while True:
            owner = self.owner[-1]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            if len(self.first) > 1 and (sizes == 1).all():
                break
            place = np.arange(len(owner)) - np.repeat(starts, sizes)
            begin = np.flatnonzero(place % SPAN == 0)
            low, high = np.bitwise_and.reduceat(low, begin, axis=0), np.bitwise_or.reduceat(high, begin, axis=0)
            shared = ~(low ^ high)
            self.first.append(np.append(begin, len(owner)))
            self.shared.append(shared)
            self.value.append(low & shared)
            self.owner.append(owner[begin])
        self.label = np.arange(len(fps))

    def _uniform(self) -> list:
        """For each node the label that all rows below it have, or -1."""
        low = high = self.label
        out: list = [None]
        for first in self.first[1:]:
            low, high = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    def link(self, most_bits: int) -> np.ndarray:
        """For each row the first row that it is linked with in its group, over any number of links of at most most_bits."""
        top = len(self.first) - 1
        roots = self.owner[top]
        root_of = np.searchsorted(roots, self.group)
        ends = [np.arange(1, len(self.fps) + 1)]
        for first in self.first[1:]:
            ends.append(ends[-1][first[1:] - 1])
        step = max(1, PAIRS // SPAN)
        stack = [(top, np.arange(i, min(i + step, len(self.fps))), None) for i in range(0, len(self.fps), step)][::-1]
        uniform, fresh = self._uniform(), True
        while stack:
            level, q, v = stack.pop()
            v = root_of[q] if v is None else v
            if len(q) > step:  # the rest waits as it is, so that a level holds PAIRS pairs at most
                stack.append((level, q[step:], v[step:]))
                q, v = q[:step], v[:step]
            if not fresh:
                uniform, fresh = self._uniform(), True
            near = (ends[level][v] > q + 1) & (uniform[level][v] != self.label[q])
            q, v = q[near], v[near]
            differences = np.bitwise_count((self.fps[q] ^ self.value[level][v]) & self.shared[level][v]).sum(axis=1, dtype=np.int64)
            near = differences <= most_bits
            q, v = q[near], v[near]
            first = self.first[level]
            n = first[v + 1] - first[v]
            below = np.repeat(first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())
            asked = np.repeat(q, n)
            if level > 1:
                stack.append((level - 1, asked, below))
                continue
            ahead = (below > asked) & (self.label[below] != self.label[asked])
            asked, below = asked[ahead], below[ahead]
            near = _apart(self.fps[asked], self.fps[below]) <= most_bits
            if near.any():
                self._join(asked[near], below[near])
                fresh = False
        return self.label


def linked(group: np.ndarray, nodes: np.ndarray, fps: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are linked in their group, and for each a node of the group that stands for its component."""
    rank = gray_rank(fps)
    order = np.lexsort((*rank.T[::-1], group))
    label = GrayIndex(group[order], fps[order]).link(most_bits)
    nodes = nodes[order]
    moved = label != np.arange(len(label))
    return nodes[moved], nodes[label[moved]]


def _links(buckets: DataFrame, words: int, most_bits: int) -> DataFrame:
    """(u, v) from groups (bucket, a, b), whose rows come together and in order."""

    def run(batches):
        freed()
        held: list[pa.Table] = []
        rows = 0

        def done(table: pa.Table):
            keys = np.stack([table.column(i).to_numpy() for i in range(3)])
            group = np.cumsum(np.concatenate(([0], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if table.num_rows else np.zeros(0, dtype=np.int64)
            u, v = linked(group, table.column(3).to_numpy(), _as_words(table.column(4), words), most_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= GROUP_ROWS:
                table = pa.concat_tables(held)
                last = [table.column(i)[-1].as_py() for i in range(3)]
                same = np.logical_and.reduce([table.column(i).to_numpy() == x for i, x in enumerate(last)])
                start = table.num_rows - int(same[::-1].argmin()) if not same.all() else 0
                if start:
                    yield done(table.slice(0, start).combine_chunks())
                held = [table.slice(start)]
                rows = table.num_rows - start
        if rows:
            yield done(pa.concat_tables(held).combine_chunks())

    return buckets.mapInArrow(run, "u bigint, v bigint")


def link_fingerprints(distinct: DataFrame, words: int, most_bits: int, masks: list[list[int]], count: int) -> DataFrame:
    """(node, root) of distinct (node, fp), as `graph.components` gives them."""
    buckets = _buckets(distinct, words, masks)
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_LEAST, HOT_TIMES * count // (1 << min(40, max(1, len(masks[0])))))
    hot = written(sizes.where(F.col("n") > least).select("bucket", F.ceil(F.col("n") / least).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        grouped = buckets.select("bucket", F.lit(0).alias("a"), F.lit(0).alias("b"), "node", "fp")
    else:
        salt = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = buckets.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = dealt.withColumn("salt", salt).withColumn("other", other)
        grouped = dealt.select("bucket", F.least("salt", "other").alias("a"), F.greatest("salt", "other").alias("b"), "node", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = grouped.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = components(_links(grouped, words, most_bits))
    discard(hot)
    return found


def labelled(found: DataFrame, words: int, most_bits: int, masks_for) -> DataFrame:
    """found (id, row, fp; a written table) with root, a number of the component, and component, its least id (null if it has none)."""
    distinct = written(found.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    count = distinct.count()
    roots = link_fingerprints(distinct, words, most_bits, masks_for(count), count)
    rooted = written(distinct.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "rooted")
    labels = written(rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root"), "labels")
    discard(distinct, roots, rooted)
    return found.join(labels, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """id_col, fingerprint (hex) and component_id of every row; fingerprints link at most_bits differing bits, exactly."""
    found = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    out = labelled(found, 1, most_bits, lambda n: exact_masks(blocks_for(n, most_bits), most_bits))
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = DEDUP_SHINGLE, similarity: float = DEDUP_SIMILARITY, words: int = WIDE, tables: int = TABLES, sample: int = SAMPLE) -> DataFrame:
    """docs without the near-duplicates of a row that stays: of each component that with the least id (and, of rows of
    one id, one). Shingle sets count without repeats. Wide fingerprints link where they differ in no more bits than sets
    of that similarity do in the mean; the tables find a pair of similarity 0.95, 0.9, 0.85 or 0.8 with a chance of about
    0.99999, 0.998, 0.98 or 0.91 each, and a component needs only one of a pair's paths."""
    found = written(fingerprints(docs, id_col, text_col, shingle, words, False), "fingerprints")
    most_bits = bits_for(similarity, 64 * words)
    marked = labelled(found, words, most_bits, lambda n: sampled_masks(words, *tables_for(n, words, most_bits, tables, sample)))
    stays = F.col("id").eqNullSafe(F.col("component"))
    keepers = written(marked.where(stays).groupBy("root").agg(F.min("row").alias("row"), F.first("id").alias("id"), F.count(F.lit(1)).alias("n")), "keepers")
    row = free_name(docs, "lm_row")
    keyed = docs.withColumn(row, row_key(id_col, text_col)).alias("d")
    same = F.col(f"d.`{id_col}`").cast("bigint").eqNullSafe(F.col("k.id")) & (F.col(f"d.`{row}`") == F.col("k.row"))
    left = keyed.join(keepers.alias("k"), same, "left_semi")
    if not keepers.where("n > 1").isEmpty():  # rows of one id: one of equal ones stays
        left = left.dropDuplicates([id_col, row])
    return left.select(*docs.columns)
