"""Substring dedup: near-duplicate passages by compact windows.

A text is a row of hashes of its five-word shingles. For each of HASHES hash functions the Cartesian tree over the
hashed shingles gives compact windows (l, c, r): every passage that begins in l..c and ends in c..r has its least hash at c.
Only windows that hold a passage of LEAST_WORDS words count, about two for each such length. A node of the tree with a
wide window is the least of some window of the least width, so two sliding extremes find these nodes, and their
neighbours in the tree are among them.

Windows of equal signature (function and shingle) hold passages that may be shared. A window's context is the shingles that
such passages can hold: those less than a passage's length away. Windows of equal signature and equal context share a passage
as they are, so one stands for all (first in each task's blocks, before anything is shuffled, then in order of signatures). Of
the rest, all holders of a signature that two texts have are compared by their contexts: one must have a run of LEAST_WORDS
words of which the other has so many shingles there that the similarity is 0.8 or more, and the other way round. The holders that
such links connect are a group, found in full: all are met with the first; few are then compared each with each, and of many
first those that share one more least hash (by HASHES other functions, over the passages that hold the signature, of other shingles) with
one of them, then all rows that hold any of the rarest shingles of a passage, so many that no row that shares it lacks them all; a sketch
of the context, or a count of its shingles where they are few, leaves out pairs that can't have so many in common. Of a run of one
shingle only the ends count as signatures. Many holders meet the first in parts; what shares no passage with it then meets all others
beside each part, or, if that is much, part by part. A passage
reaches as far as the verified runs of its signatures.

Equal texts are one text to the search, and a class of their own kind if they are long enough to hold a passage.

Defined results: every document has a row; null, empty and short texts have no passages and are each a class of their own, equal
ones too; a null id never is a class's id unless all of the class are null; A-Z count as a-z; an empty table gives no
rows; other columns are not read. Texts are told apart by 64-bit hashes, and shingles in a comparison by 24-bit ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import cut, discard, spread, written
from lamella.llm.graph import components

SHINGLE, LEAST_WORDS, HASHES, SIMILARITY = 5, 50, 4, 0.8
BLOCK_SHINGLES = 400_000
SEEN = 500_000
SPLIT_LEAST = 4096  # holders of a signature from which on they meet its first in parts
HOT_LEAST = 100_000  # holders from which on those that don't share a passage with it are dealt into pairs of parts
SPLIT_PART = -1
BROADCAST_ROWS = 100_000  # rows of 28 bytes on signatures of many holders
FEW, MANY = 24, 256  # holders that are compared each with each, at once and block by block
COMPARED, TASK_ROWS = 4_000, 50_000
LOOKED_UP = 8_000_000  # rows of hashes, before what is connected by now is left out
SKETCH, COARSE = 64, 8  # words of 64 bits of a context's sketches
SHORT = 24  # hashes of a context that is compared by how often each stands there
#: Kinds of rows of the first pass.
WINDOW, LINK, TEXT = 0, 1, 2
SEED = 42
_MULTIPLIER, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash that follows from h."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((_MULTIPLIER * (k + 1)) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _ranked(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function for least hashes: 32 bits, never 0."""
    with np.errstate(over="ignore"):
        return np.maximum(((h ^ (h >> np.uint64(29 + k))) * np.uint64((_MULTIPLIER * (2 * k + 3)) & (1 << 64) - 1)) >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z alone changes, \x20 and \x09-\x0D part words


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """64-bit hashes of the shingles of a text: of the hashes of their words, in order."""
    n = len(words) - shingle + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            out = out * np.uint64(_BASE) + h[k : k + n]
    return _mixed(out, 0)


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over every so many neighbours."""
    size = 1
    while 2 * size <= width:
        a, size = op(a[..., :-size], a[..., size:]), 2 * size
    rest = width - size
    return op(a[..., :-rest], a[..., rest:]) if rest else a


def compact_windows(hashed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of at least that width; zeros part the texts, and no window holds one. Of equal hashes the first
    counts as the least."""
    if len(hashed) < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    least = sliding(np.minimum, hashed, width)
    pad = np.zeros(width - 1, dtype=hashed.dtype)
    widest = sliding(np.maximum, np.concatenate([pad, least, pad]), width)
    at = np.flatnonzero((hashed == widest) | (hashed == 0))
    values, places = hashed[at].tolist(), at.tolist()
    left, right, stack = [-1] * len(places), [len(hashed)] * len(places), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i]
        if stack:
            left[i] = places[stack[-1]]
        stack.append(i)
    l, r = np.array(left) + 1, np.array(right) - 1  # noqa: E741
    good = (hashed[at] > 0) & (r - l + 1 >= width)
    return l[good], at[good], r[good]


def text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, b, dtype=np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


class _Block:
    """Some texts at once, as one row of shingles with gaps, and the rows that the first pass makes of them."""

    def __init__(self, uids: list[int], texts: list[np.ndarray], width: int):
        self.width, self.uids = width, np.array(uids, dtype=np.int64)
        sizes = np.array([len(x) + 1 for x in texts])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        gap = np.zeros(1, dtype=np.uint64)
        self.x = np.concatenate([y for x in texts for y in (x, gap)])
        with np.errstate(over="ignore"):
            up, self.down = _powers(len(self.x))
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.x * up[:-1])])

    def ends_of_runs(self, c: np.ndarray) -> np.ndarray:
        """Places c without those within a run of one shingle: what holds such a place has an end of the run, or lies in the run and
        is as a passage at its first place."""
        fresh, of = runs(self.x)
        last = np.append(np.flatnonzero(fresh)[1:], len(self.x))[np.cumsum(fresh) - 1] - 1
        return np.unique(np.where(of[c] == c, c, last[c]))

    def contexts(self, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """A hash of the shingles around each place, and of where they begin and end."""
        low, high = np.maximum(c - self.width + 1, self.starts[doc]), np.minimum(c + self.width, self.ends[doc] - 1)
        with np.errstate(over="ignore"):
            inside = (self.sums[high] - self.sums[low]) * self.down[low]
        return _mixed(inside, 1) ^ _mixed(((c - low) * 2 * self.width + high - c).astype(np.uint64), 2)

    def rows(self, m: int) -> pa.RecordBatch:
        """Windows by one hash function; of those with equal signatures and contexts one text's alone, and links of all."""
        y = _ranked(self.x, m)
        y[self.ends - 1] = 0
        _, c, _ = compact_windows(y, self.width)
        c = self.ends_of_runs(c)
        doc = np.searchsorted(self.ends, c, side="right")
        key, context = _mixed(self.x[c], m + 101).view(np.int64), self.contexts(c, doc).view(np.int64)
        at, uid = (c - self.starts[doc]).astype(np.int32), self.uids[doc]
        by = np.lexsort((at, uid, context, key))
        key, context, at, uid = key[by], context[by], at[by], uid[by]
        fresh, of = runs(key, context)
        again, shared, other = partners(uid, of)
        parts = [_first_pass(WINDOW, key[~again], context[~again], uid[~again], at[~again], uid[~again])]
        return pa.Table.from_batches([*parts, _first_pass(LINK, uid[shared], context[shared], uid[shared], at[shared], other[shared])]).combine_chunks().to_batches()[0]


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: whether a row differs from the one before, and the first row that is equal to it."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return fresh, np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(fresh) else np.zeros(0, dtype=np.int64)


def partners(uid: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of their run, then text: whether the text isn't its run's first, whether the run has several, and another."""
    n = len(uid)
    if not n:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool), uid
    stop = np.append(np.flatnonzero(of[1:] != of[:-1]), n - 1)
    first, last = uid[of], uid[stop][np.searchsorted(stop, np.arange(n))]
    return uid != first, first != last, np.where(uid != first, first, last)


def _first_pass(kind: int, key, context, uid, at, other) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(uid), kind), pa.int8()), pa.array(key, pa.int64()), pa.array(context, pa.int64()), pa.array(uid, pa.int64()), pa.array(at, pa.int32()), pa.array(other, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "context", "uid", "at", "other"])


def _windows(docs: DataFrame, text_col: str, shingle: int, least_words: int, hashes: int) -> DataFrame:
    """Of every distinct text of a task that can hold a passage: a row of kind TEXT (at: its words), WINDOW rows (key: the
    signature; at: the shingle that it is of) and LINK rows (other: a text with the same passage)."""
    width = least_words - shingle + 1

    def run(batches):
        uids, lengths, texts, held, seen = [], [], [], 0, set()

        def block():
            made, own = _Block(uids, texts, width), np.array(uids, dtype=np.int64)
            yield _first_pass(TEXT, own, own, own, np.array(lengths, dtype=np.int32), own)
            for m in range(hashes):
                yield made.rows(m)

        for b in cut(batches, 1):
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if uid in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(uid)
                words = words_of(text or "")
                if len(words) >= least_words:
                    uids.append(uid)
                    lengths.append(len(words))
                    texts.append(shingles(words, shingle))
                    held += len(texts[-1])
                if held >= BLOCK_SHINGLES:
                    yield from block()
                    uids, lengths, texts, held = [], [], [], 0
        if held:
            yield from block()

    return spread(docs.select(text_key(text_col), F.col(text_col))).mapInArrow(run, "kind tinyint, key bigint, context bigint, uid bigint, at int, other bigint")


def _met(windows: DataFrame) -> DataFrame:
    """From windows in order of (key, context, uid, at): one of each context of a signature that has several (WINDOW); links of
    all texts of a context that has several (LINK); and the rows of other kinds. Of a batch, what the next one needs of its last
    context is held: its first text's rows, or one of them once they are linked."""
    names = ["kind", "key", "uid", "at", "other"]

    def rows(kind, key, uid, at, other):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), kind), pa.int8()), pa.array(key), pa.array(uid), pa.array(at), pa.array(other)], names=names)

    def run(batches):
        held = [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.int32)]
        linked = sent = False  # of the held rows: whether their links, and their window, have been given
        for b in batches:
            kind = b.column(0).to_numpy()
            own = kind == WINDOW
            if not own.all():
                some = b.filter(pa.array(~own))
                yield pa.RecordBatch.from_arrays([some.column(i) for i in (0, 1, 3, 4, 5)], names=names)
            if not own.any():
                continue
            before = len(held[0])
            key, context, uid, at = (np.concatenate([h, b.column(i).to_numpy()[own]]) for h, i in zip(held, (1, 2, 3, 4)))
            _, of = runs(key, context)
            again, shared, other = partners(uid, of)
            if linked:
                shared[:before] = False
            yield rows(LINK, uid[shared], uid[shared], at[shared], other[shared])
            # the first context of a signature is given when a second one comes
            new_key, head = runs(key)
            second = (of == np.arange(len(key))) & ~new_key
            several = second.copy()
            several[head[second]] = True
            given = several.copy()
            if before and sent:
                given[0] = False
            yield rows(WINDOW, key[given], uid[given], at[given], uid[given])
            last = of[-1]
            linked = bool(again[-1]) or bool(before and last == 0 and linked)
            sent = bool(several[last]) or bool(before and last == 0 and sent)
            keep = np.flatnonzero((of == last) & ~again)
            held = [c[keep[:1] if linked else keep] for c in (key, context, uid, at)]

    return windows.mapInArrow(run, "kind tinyint, key bigint, uid bigint, at int, other bigint")


# ---- contexts and their comparison


def _contexts(docs: DataFrame, wanted: DataFrame, rows: DataFrame, id_col: str, text_col: str, shingle: int, width: int) -> DataFrame:
    """(key, uid, at, hashes) of the wanted (key, uid, at): 24-bit hashes, never 0, of the shingles less than width from the
    one at that place; 0 where the text has none. One row of each text is read, and texts are dealt by it, so copies spread."""
    asked = wanted.groupBy("uid").agg(F.collect_set(F.struct("key", "at")).alias("places"))
    asked = asked.join(rows.groupBy("uid").agg(F.min("id").alias("id")), "uid")
    asked = asked.select(F.col("uid").alias("asked"), "id", F.col("places.key").alias("keys"), F.col("places.at").alias("ats"))
    texts = docs.select(text_key(text_col).alias("uid"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))

    def run(batches):
        done = set()
        for b in cut(batches, 1):
            for uid, text, keys, ats in zip(*(b.column(i).to_pylist() for i in range(4))):
                if uid in done:  # a repeated row
                    continue
                done.add(uid)
                h = shingles(words_of(text or ""), shingle)
                own = np.zeros(len(h) + 2 * width, dtype="<u4")
                own[width : width + len(h)] = np.maximum(h & np.uint64(0xFFFFFF), np.uint64(1))
                data = own.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                hashes = [data[3 * (p + 1) : 3 * (p + 2 * width)] for p in ats]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(ats), uid)), pa.array(ats, pa.int32()), pa.array(hashes, pa.binary())], names=["key", "uid", "at", "hashes"])

    joined = texts.join(asked, (F.col("uid") == F.col("asked")) & F.col("own").eqNullSafe(F.col("id")))
    return joined.select("uid", "text", "keys", "ats").mapInArrow(run, "key bigint, uid bigint, at int, hashes binary")


def sketches(contexts: np.ndarray) -> np.ndarray:
    """Of each row a set of 64 x SKETCH bits, one for each of its hashes."""
    bits = np.zeros((len(contexts), SKETCH), dtype=np.uint64)
    rows = np.arange(len(contexts))
    for k in range(contexts.shape[1]):
        h = contexts[:, k]
        bits[rows, (h >> 6) % SKETCH] |= np.where(h > 0, np.uint64(1) << (h & 63).astype(np.uint64), np.uint64(0))
    return bits


def covered(there: np.ndarray, width: int, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, whether a window of that width has so many shingles that are there; the first and the last such window."""
    sums = np.cumsum(there, axis=1, dtype=np.int16 if there.shape[1] < 1 << 15 else np.int64)
    sums = np.concatenate([sums[:, width - 1 : width], sums[:, width:] - sums[:, :-width]], axis=1)
    good = sums >= needed
    return good.any(axis=1), good.argmax(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1)


def aligned(a: np.ndarray, b: np.ndarray, width: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of two tables of contexts, whether they share a passage shingle by shingle, and the first and the last shingle of
    it in both (good, spans: first, last, and the other's)."""
    good, first, last = covered((a == b) & (a > 0), width, needed)
    return good, np.stack([first, last, first, last])


def shifted(a: np.ndarray, b: np.ndarray, width: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, wherever in the context a shingle stands."""
    here, there = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    for d in range(a.shape[1]):
        ahead, behind = slice(d, None), slice(None, a.shape[1] - d)
        for u, v in ((ahead, behind), (behind, ahead)):
            same = a[:, u] == b[:, v]
            here[:, u] |= same
            there[:, v] |= same
    (good, f, e), (other, of, oe) = covered(here & (a > 0), width, needed), covered(there & (b > 0), width, needed)
    return good & other, np.stack([f, e, of, oe])


def verified(a: np.ndarray, b: np.ndarray, width: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, by either."""
    good, spans = aligned(a, b, width, needed)
    k = np.flatnonzero(~good)
    good[k], spans[:, k] = shifted(a[k], b[k], width, needed)
    return good, spans


class Groups:
    """Rows of contexts, and what verified pairs of them connect."""

    def __init__(self, contexts: np.ndarray, width: int, needed: int):
        self.contexts, self.width, self.needed = contexts, width, needed
        n = len(contexts)
        self.fine = sketches(contexts)
        self.bits = np.bitwise_or.reduce(self.fine.reshape(n, -1, COARSE), axis=1)
        self.beyond = (contexts > 0).sum(axis=1) - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.label = np.arange(n)
        self.low, self.high = np.full(n, contexts.shape[1]), np.full(n, -1)
        # rows of few hashes, again and again, whose sketches say little: their hashes, and how often each stands there
        ordered = np.sort(contexts, axis=1)
        fresh = ordered > 0
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        kinds = fresh.sum(axis=1)
        rows = np.flatnonzero(kinds <= SHORT)
        self.short = np.full(n, -1)
        self.short[rows] = np.arange(len(rows))
        self.values, self.counts = np.zeros((len(rows), SHORT), dtype=contexts.dtype), np.zeros((len(rows), SHORT), dtype=np.int16)
        i, at = np.nonzero(fresh[rows])
        place = np.arange(len(i)) - (np.cumsum(kinds[rows]) - kinds[rows])[i]
        self.values[i, place] = ordered[rows[i], at]
        stop = np.append(at[1:], 0)
        stop[np.append(i[1:] != i[:-1], True)[: len(i)]] = contexts.shape[1]
        self.counts[i, place] = stop[: len(i)] - at

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether so many places of each row of pairs hold what the other row has; said of all pairs without a short row."""
        out = np.ones(len(i), dtype=bool)
        for a, b, k in ((i, j, self.short[i] >= 0), (j, i, (self.short[j] >= 0) & (self.short[i] < 0))):
            k = np.flatnonzero(k)
            if not len(k):
                continue
            own, other = self.short[a[k]], self.short[b[k]]
            for both in (True, False):
                some = (other >= 0) == both
                if not some.any():
                    continue
                values, counts = self.values[own[some]], self.counts[own[some]]
                theirs, times = (self.values[other[some]], self.counts[other[some]]) if both else (self.contexts[b[k[some]]], 1)
                same = (values[:, :, None] == theirs[:, None, :]) & (theirs > 0)[:, None, :]
                out[k[some]] = ((same.any(axis=2) * counts).sum(axis=1) >= self.needed) & ((same.any(axis=1) * times).sum(axis=1) >= self.needed)
        return out

    def may_hold(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Whether each row may hold each of its hashes: false where the sketch lacks it."""
        words = self.fine[rows[:, None], (hashes >> 6) % SKETCH]
        return ((words >> (hashes & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & (hashes > 0)

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes in the pairs (i, j) that share a passage and aren't connected yet."""
        for k in range(0, len(i), COMPARED):
            x, y = i[k : k + COMPARED], j[k : k + COMPARED]
            apart = self.label[x] != self.label[y]
            x, y = x[apart], y[apart]
            near = np.bitwise_count(self.bits[x] & self.bits[y]).sum(axis=1, dtype=np.int64) >= self.needed - np.minimum(self.beyond[x], self.beyond[y])
            x, y = x[near], y[near]
            if len(x):
                near = self.common(x, y)
                x, y = x[near], y[near]
            if not len(x):
                continue
            a, b = self.contexts[x], self.contexts[y]
            good, spans = aligned(a, b, self.width, self.needed)
            rest = np.flatnonzero(~good)
            rest = rest[covered(self.may_hold(y[rest], a[rest]), self.width, self.needed)[0]]
            rest = rest[covered(self.may_hold(x[rest], b[rest]), self.width, self.needed)[0]]
            if len(rest):
                good[rest], spans[:, rest] = shifted(a[rest], b[rest], self.width, self.needed)
            x, y = x[good], y[good]
            for end, f, e in ((x, *spans[:2, good]), (y, *spans[2:, good])):
                np.minimum.at(self.low, end, f)
                np.maximum.at(self.high, end, e + self.width - 1)
            self.join(x, y)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while ((jumped := label[label]) != label).any():
                label[:] = jumped

    def search(self, group: np.ndarray, rows: np.ndarray) -> None:
        """Connects the rows of each group (rows in order of their groups) that a chain of pairs connects."""
        if not len(rows):
            return
        _, of = runs(group)
        begin = np.flatnonzero(of == np.arange(len(rows)))
        sizes = np.diff(np.append(begin, len(rows)))
        # most groups are all connected with their first row; the others are searched
        rest = of != np.arange(len(rows))
        self.compare(rows[of[rest]], rows[rest])
        label = self.label[rows]
        left = np.add.reduceat((label != label[of]).astype(np.int64), begin)
        for k in np.flatnonzero((left > 0) & (sizes > FEW)).tolist():
            some = rows[begin[k] : begin[k] + sizes[k]]
            if len(some) > MANY:
                self.by_second_hash(some)
                self.by_rarest(some)
            else:
                self.each_with_each(some)
        few = np.repeat((left > 0) & (sizes <= FEW), sizes)
        rows, group = rows[few], group[few]
        for d in range(1, FEW):
            i = np.flatnonzero(group[d:] == group[:-d]) if len(rows) > d else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            self.compare(rows[i], rows[i + d])

    def each_with_each(self, rows: np.ndarray) -> None:
        """Connects the rows of one group, some at a time against those after them, by the sketches first. A row that shares no passage
        with the group's first must have some of what the first lacks in common with any other row."""
        c = self.contexts[rows]
        lacking = (c > 0) & ~np.isin(c, c[0])
        sums = np.cumsum((c > 0) & ~lacking, axis=1, dtype=np.int32)
        shared = np.maximum(sums[:, self.width - 1], (sums[:, self.width :] - sums[:, : -self.width]).max(axis=1))
        own = sketches(np.where(lacking, c, 0))
        wanted = self.needed - shared - (lacking.sum(axis=1) - np.bitwise_count(own).sum(axis=1, dtype=np.int64))

        def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [slice(k, k + COMPARED) for k in range(0, len(i), COMPARED)]
            good = [np.bitwise_count(own[i[p]] & self.fine[rows[j[p]]]).sum(axis=1, dtype=np.int64) >= wanted[i[p]] for p in parts]
            good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
            return i[good], j[good]

        step = max(1, 200_000 // len(rows))
        for k in range(0, len(rows) - 1, step):
            x, y = rows[k : k + step], rows[k + 1 :]
            common = np.bitwise_count(self.bits[x][:, None] & self.bits[y][None]).sum(axis=2, dtype=np.int16)
            near = (common >= self.needed - np.minimum(self.beyond[x][:, None], self.beyond[y][None])) & (self.label[x][:, None] != self.label[y][None])
            i, j = np.nonzero(near)
            i, j = i[j >= i] + k, j[j >= i] + k + 1
            i, j = kept(i, j)
            j, i = kept(j, i)
            self.compare(rows[i], rows[j])

    def by_second_hash(self, rows: np.ndarray) -> None:
        """Connects most rows of a large group at little cost, before all are searched: those with the same least hash, but for the
        signature's own, of a passage that holds it are met with the first of them."""
        contexts, made = self.contexts[rows].astype(np.uint64), []
        for m in range(HASHES):
            y = _ranked(_mixed(contexts, 300 + m), 0)
            y[contexts == contexts[:, self.width - 1 : self.width]] = np.iinfo(np.uint32).max
            y[contexts == 0] = 0
            least = sliding(np.minimum, y, self.width)
            fresh = least > 0
            fresh[:, 1:] &= least[:, 1:] != least[:, :-1]
            i, at = np.nonzero(fresh)
            made.append((least[i, at].astype(np.int64) * HASHES + m, rows[i]))
        group, of = (np.concatenate(x) for x in zip(*made))
        by = np.lexsort((of, group))
        group, of = group[by], of[by]
        _, first = runs(group)
        self.compare(of[first], of)

    def rare(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts: (times, run) of each place, how many rows hold its hash and which of the hashes, in order, it is; and of each hash its
        rows: (owner, begin, size)."""
        n, span = c.shape
        keys = np.sort((c.astype(np.int64) * (n * span) + np.arange(n * span).reshape(n, span)).ravel())
        h, place = np.divmod(keys, n * span)
        row = place // span
        new, _ = runs(h)
        fresh, _ = runs(h, row)
        of = np.cumsum(new) - 1
        size = np.bincount(of[fresh])
        times, run = np.zeros(n * span, dtype=np.int64), np.zeros(n * span, dtype=np.int64)
        times[place], run[place] = np.where(h > 0, size[of], 0), of
        return times.reshape(n, span), run.reshape(n, span), row[fresh], np.cumsum(size) - size, size

    def by_rarest(self, rows: np.ndarray) -> None:
        """Connects all rows of a large group that pairs connect. A passage lacks no more than width - needed of its places in the other
        row, so of any one more than that the other row holds one: the rarest of each passage are looked up in all rows. What has too many
        shingles of its own in every passage shares none with any row, and goes first."""
        spare = self.width - self.needed
        while True:
            if len(rows) < 2:
                return
            c = self.contexts[rows]
            times, run, owner, begin, size = self.rare(c)
            good = covered(times > 1, self.width, self.needed)[0]
            if good.all():
                break
            rows = rows[good]
        n, span = c.shape
        asked = []
        step = COMPARED // 4
        for k in range(0, n, step):
            # places in order of rarity, and the last of the rarest in each passage that can be shared
            order = times[k : k + step] * span + np.arange(span)
            last = np.partition(np.lib.stride_tricks.sliding_window_view(order, self.width, axis=1), spare, axis=2)[:, :, spare]
            shared = np.cumsum(np.pad(times[k : k + step] > 1, ((0, 0), (1, 0))), axis=1)
            last[shared[:, self.width :] - shared[:, : -self.width] < self.needed] = -1
            most = sliding(np.maximum, np.pad(last, ((0, 0), (self.width - 1,) * 2), constant_values=-1), self.width)
            i, at = np.nonzero((order <= most) & (times[k : k + step] > 1))
            asked.append(np.unique(run[k + i, at] * n + k + i))
        of, i = np.divmod(np.concatenate(asked), n)
        by = np.argsort(size[of], kind="stable")
        of, i = of[by], i[by]
        while len(of):
            # hashes whose rows are all connected have no more to say
            label = self.label[rows]
            held = label[owner]
            open_ = (np.minimum.reduceat(held, begin) < np.maximum.reduceat(held, begin))[of]
            of, i = of[open_], i[open_]
            total = np.cumsum(size[of])
            now = max(1, int(np.searchsorted(total, LOOKED_UP)))
            cut_at = np.flatnonzero(np.diff(total[:now] // (LOOKED_UP // 16))) + 1
            for own, x in zip(np.split(of[:now], cut_at), np.split(i[:now], cut_at)):
                times_ = size[own]
                at = np.arange(times_.sum()) - np.repeat(np.cumsum(times_) - times_, times_)
                x, y = np.repeat(x, times_), owner[np.repeat(begin[own], times_) + at]
                apart = (x < y) & (label[x] != label[y])
                x, y = np.divmod(np.unique(x[apart] * n + y[apart]), n)
                self.compare(rows[x], rows[y])
            of, i = of[now:], i[now:]


def grouped(group: np.ndarray, contexts: np.ndarray, width: int, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of their group: the least row that verified pairs of the group connect each with, and the first and the
    last shingle of its passages."""
    found = Groups(contexts, width, needed)
    found.search(group, np.arange(len(group)))
    return found.label, found.low, found.high


def unpacked(hashes: list[bytes], width: int) -> np.ndarray:
    """Contexts as rows of 32-bit integers."""
    b = np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 2 * width - 1, 3).astype(np.uint32)
    return b[:, :, 0] | b[:, :, 1] << np.uint32(8) | b[:, :, 2] << np.uint32(16)


def _verified(dealt: DataFrame, parts: int, width: int, needed: int, shingle: int) -> DataFrame:
    """From (key, a, b, lead, uid, at, hashes), grouped by the first three: (uid, other, start, stop) of what verified passages connect,
    and, of groups with b = SPLIT_PART, the rows that nothing connects with those that lead: (uid, start: at, key, hashes)."""

    def done(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(i).to_numpy() for i in range(3)]
        lead = table.column(3).to_numpy()
        uid, at = (table.column(i).to_numpy() for i in (4, 5))
        label, low, high = grouped(np.cumsum(runs(*keys)[0]), unpacked(table.column(6).to_pylist(), width), width, needed)
        # a text's own repeats count if another text has them too
        least, most = np.full(len(uid), np.iinfo(np.int64).max), np.full(len(uid), np.iinfo(np.int64).min)
        np.minimum.at(least, label, uid)
        np.maximum.at(most, label, uid)
        k = np.flatnonzero((least < most)[label] & (high >= 0))
        start = np.maximum(0, at[k] - width + 1 + low[k])
        stop = at[k] - width + 1 + high[k] + shingle
        rest = np.flatnonzero((keys[2] == SPLIT_PART) & ~np.isin(label, label[lead]))
        other = np.where(uid == least[label], most[label], least[label])
        none = [None] * len(k)
        columns = [
            pa.array(np.concatenate([uid[k], uid[rest]])),
            pa.array([*other[k].tolist(), *[None] * len(rest)], pa.int64()),
            pa.array(np.concatenate([start, at[rest]]).astype(np.int32)),
            pa.array([*stop.tolist(), *[None] * len(rest)], pa.int32()),
            pa.array([*none, *keys[0][rest].tolist()], pa.int64()),
            pa.array([*none, *table.column(6).take(pa.array(rest)).to_pylist()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["uid", "other", "start", "stop", "key", "hashes"])

    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= TASK_ROWS and b.num_rows:
                table = pa.concat_tables(held)
                same = np.logical_and.reduce([table.column(i).to_numpy() == table.column(i)[-1].as_py() for i in range(3)])
                start = 0 if same.all() else table.num_rows - int(same[::-1].argmin())
                if start:
                    yield done(table.slice(0, start))
                held = [table.slice(start)]
                rows = table.num_rows - start
        if rows:
            yield done(pa.concat_tables(held))

    ordered = dealt.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b", F.desc("lead"))
    return ordered.mapInArrow(run, "uid bigint, other bigint, start int, stop int, key bigint, hashes binary")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least_words: int = LEAST_WORDS, hashes: int = HASHES, similarity: float = SIMILARITY, hot: int = HOT_LEAST, split: int = SPLIT_LEAST, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid, other, start, stop): a passage (in words) of a text (by key), and a text that shares it, or one of its group; a passage
    may reach beyond the text's end. And (uid, words) of the texts that can hold a passage. rows: (id, uid) of docs, if written."""
    width = least_words - shingle + 1
    needed = int(np.ceil(width * 2 * similarity / (1 + similarity)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("uid")) if rows is None else rows
    windows = _windows(docs, text_col, shingle, least_words, hashes)
    first = written(_met(windows.repartition(parts, "key").sortWithinPartitions("key", "context", "uid", "at")), "windows")
    wanted = first.where(F.col("kind") == WINDOW).select("key", "uid", "at")
    met = written(_contexts(docs, wanted, rows, id_col, text_col, shingle, width), "contexts")
    large = wanted.groupBy("key").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > split)
    large = written(large.withColumn("parts", F.ceil(F.col("n") / split).cast("int")), "signatures")
    lead, salt = F.col("uid").eqNullSafe(F.col("least")), F.pmod(F.xxhash64("uid", "at"), F.col("parts")).cast("int")
    small = large.count() <= BROADCAST_ROWS
    own = met.join(F.broadcast(large) if small else large, "key", "left")
    part = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(lead, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(salt)))
    dealt = own.select("key", part.alias("a"), F.when(F.col("parts").isNull(), 0).otherwise(SPLIT_PART).alias("b"), (F.col("parts").isNotNull() & lead).alias("lead"), "uid", "at", "hashes")
    near = written(_verified(dealt, parts, width, needed, shingle), "links")
    left = near.where("hashes is not null")
    if left.isEmpty():
        later = None
    else:
        # what has no link with a large signature's first holder meets all others: beside each part of them, or, if it is much, part by part
        open_ = written(left.select("key", "uid", F.col("start").alias("at")).distinct(), "open")
        asked = open_.groupBy("key").agg(F.count(F.lit(1)).alias("open")).join(large, "key")
        asked = asked.withColumn("few", F.col("open") <= split).withColumn("parts", F.when(F.col("few"), F.col("parts")).otherwise(F.ceil(F.col("n") / hot).cast("int")))
        asked = asked.select("key", "few", "parts")
        both = met.join(F.broadcast(asked) if small else asked, "key").join(open_.withColumn("is_open", F.lit(True)), ["key", "uid", "at"], "left")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        both = both.withColumn("salt", salt).withColumn("part", F.explode(F.when(F.col("few") & F.col("is_open").isNull(), F.array("salt")).otherwise(every)))
        pair = (F.when(F.col("few"), F.col("part")).otherwise(f("salt", "part")) for f in (F.least, F.greatest))
        later = written(_verified(both.select("key", *(p.alias(k) for p, k in zip(pair, "ab")), F.lit(False).alias("lead"), "uid", "at", "hashes"), parts, width, needed, shingle), "links")
        discard(open_)
    equal = first.where(F.col("kind") == LINK).select("uid", "other", F.greatest(F.lit(0), F.col("at") - (width - 1)).alias("start"), (F.col("at") + least_words).alias("stop"))
    texts = written(first.where(F.col("kind") == TEXT).groupBy("uid").agg(F.max("at").alias("words")), "texts")
    verified_ = [x.where("hashes is null").select("uid", "other", "start", "stop") for x in (near, later) if x is not None]
    found = written(reduce(DataFrame.union, verified_, equal).distinct(), "links")
    discard(first, met, large, near, *([later] if later is not None else []))
    return found, texts


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, **parameters) -> DataFrame:
    """One row per document: id_col, class_id (the least id that passages connect it with), n_links (the other documents of
    its class) and passages (start, stop in words, merged, in order)."""
    rows = written(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("uid")), "rows")
    found, words = links(docs, id_col, text_col, least_words=least_words, rows=rows, **parameters)
    own = found.groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("passages"))
    roots = components(found.select(F.col("uid").alias("u"), F.col("other").alias("v")))
    texts = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).join(words, "uid")
    texts = texts.join(own, "uid", "left").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    texts = written(texts, "texts")
    least = written(texts.groupBy("root").agg(F.min("least").alias("class_id"), (F.sum("copies") - 1).alias("n_links")), "classes")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("stop")))
    none = F.array().cast("array<struct<start: int, stop: int>>")
    made = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("passages", none))
    labels = written(texts.join(least, "root").select("uid", "class_id", "n_links", "words", made.alias("passages")).transform(_merged), "labels")
    discard(texts, least, found, words, roots)
    out = rows.select("id", "uid").join(labels, "uid", "left")
    known = F.col("n_links").isNotNull()
    return out.select(F.col("id").alias(id_col), F.when(known, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("passages", none).alias("passages"))


def _merged(labels: DataFrame) -> DataFrame:
    """labels with overlapping spans joined, within the text; a text has fewer spans than words for each hash function."""
    names = [c for c in labels.columns if c != "words"]

    def run(batches):
        for b in batches:
            out = []
            for words, spans in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                joined: list[list[int]] = []
                for start, stop in sorted((s["start"], min(words, s["stop"])) for s in spans):
                    if joined and start <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], stop)
                    else:
                        joined.append([start, stop])
                out.append([{"start": s, "stop": e} for s, e in joined])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=names)

    return labels.mapInArrow(run, labels.drop("words").schema)
