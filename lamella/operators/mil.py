"""Mean intercept lengths and the degree of anisotropy.

Parallel lines along many directions sample a volume in steps. The volume is held in blocks of packed bits; a task takes a block and some
directions, draws the lines once, works out which samples of each lie in the block, and counts the changes of phase between them. A line that goes
on in other blocks leaves its first and last phase there, and where its parts meet, in order, the changes at the borders of blocks are
added. Lines follow from the seed and the direction's number, so the vectors are the same for any blocks and partitions, and no task
holds more of the volume than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import blocks as dense
from lamella.operators import fits

LEAST_INCREMENT = 1.73
SAMPLES, LINES = 500_000, 8192  # at a time
BLOCK = 128
CHUNK = 25  # directions that a task takes at once


def direction(seed: int, i: int) -> tuple[np.ndarray, np.random.Generator]:
    """Direction i: two vectors of a plane and its normal, by an even random rotation."""
    rng = np.random.default_rng([seed, i])
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return turn, rng


def phase_changes(volume: np.ndarray, origins: np.ndarray, starts: np.ndarray, counts: np.ndarray, along: np.ndarray, increment: float) -> int:
    """Changes of phase along lines that are sampled so many times; points out of the volume are passed over."""
    changes, size = 0, np.array(volume.shape)
    cut = np.flatnonzero(np.diff(np.cumsum(counts) // SAMPLES, prepend=0)).tolist()
    for low, high in zip([0, *cut], [*cut, len(counts)]):
        n = counts[low:high]
        line = np.repeat(np.arange(low, high), n)
        step = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        at = (origins[line] + (starts[line] + step * increment)[:, None] * along).astype(np.int64)
        good = ((at >= 0) & (at < size)).all(axis=1)
        at, line = at[good], line[good]
        phase = volume[at[:, 0], at[:, 1], at[:, 2]]
        fresh = np.diff(line, prepend=-1) != 0
        before = np.concatenate(([False], phase[:-1])) & ~fresh
        changes += int((phase != before).sum())
    return changes


def lines_of(shape: tuple[int, int, int], turn: np.ndarray, rng: np.random.Generator, length: float, sections: int, increment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(origins, starts, counts, length): lines of so much length in all, stratified over the plane, each sampled so many times from
    its start on; the last one is cut to fit."""
    size = np.array(shape, dtype=float)
    diagonal, centre, along = float(np.linalg.norm(size)), size / 2, turn[:, 2]
    reach = np.abs(turn[:, :2]).T @ size / 2  # of the volume's shadow on the plane
    down, across = (x.ravel().astype(float) for x in np.indices((sections, sections)))
    got, empty, made = 0.0, 0, []
    while got < length and empty < 100:
        cells = rng.permutation(sections * sections)
        jitter = rng.random((len(cells), 2))
        u = ((across[cells] + jitter[:, 0]) / sections - 0.5) * diagonal
        offsets = rng.random(len(cells))
        near = np.flatnonzero(np.abs(u) <= reach[0])
        v = ((down[cells[near]] + jitter[near, 1]) / sections - 0.5) * diagonal
        both = np.flatnonzero(np.abs(v) <= reach[1])
        near, v = near[both], v[both]
        u, offsets = u[near], offsets[near] * increment
        origins = centre + u[:, None] * turn[:, 0] + v[:, None] * turn[:, 1]
        low, high = crossed(origins, along, np.zeros(3), size)
        starts = low + offsets
        hits = np.flatnonzero(high > starts)
        empty = 0 if len(hits) else empty + 1
        # whole lines as long as they last, then a part of one
        ends = got + np.cumsum(high[hits] - starts[hits])
        whole = int(np.searchsorted(ends, length, side="right"))
        counts = np.ceil((high[hits[:whole]] - starts[hits[:whole]]) / increment).astype(np.int64)
        got = float(ends[whole - 1]) if whole else got
        if whole < len(hits) and got < length:
            counts = np.append(counts, max(1, round((length - got) / increment)))
            got = length
        made.append((origins[hits[: len(counts)]], starts[hits[: len(counts)]], counts))
    return *(np.concatenate(x) for x in zip(*made)), got


def crossed(origins: np.ndarray, along: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where lines are within a box; the first is beyond the second where they miss it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        first, last = np.full(len(origins), -np.inf), np.full(len(origins), np.inf)
        for at, way, l, h in zip(origins.T, along, low, high):  # noqa: E741
            if way == 0:
                inside = (at >= l) & (at < h)
                a, b = np.where(inside, -np.inf, np.inf), np.where(inside, np.inf, -np.inf)
            else:
                a, b = (l - at) / way, (h - at) / way
                a, b = np.minimum(a, b), np.maximum(a, b)
            np.maximum(first, a, out=first)
            np.minimum(last, b, out=last)
    return first, last


def mil_vector(volume: np.ndarray, turn: np.ndarray, rng: np.random.Generator, length: float, sections: int, increment: float) -> np.ndarray:
    """The direction, as long as the mean intercept: changes of phase either way are counted along the lines of a whole volume; a line
    that begins in the foreground counts one."""
    origins, starts, counts, got = lines_of(volume.shape, turn, rng, length, sections, increment)
    return turn[:, 2] * (got / max(1, phase_changes(volume, origins, starts, counts, turn[:, 2], increment)))


#: What a line leaves in a block: its number, its first sample there, and the phases of the first and the last.
_PART = np.dtype([("line", "<i4"), ("first", "<i4"), ("begins", "?"), ("ends", "?")])


def block_changes(volume: np.ndarray, low: np.ndarray, shape: tuple[int, int, int], lines: tuple, along: np.ndarray, increment: float) -> tuple[int, np.ndarray]:
    """(changes, parts) in a block (x, y, z) of a volume of that shape, whose first position is low: the changes of phase between samples
    of a line in the block, with those of lines that lie in it as a whole; and what the other lines leave."""
    origins, starts, counts = lines
    size = np.array(shape)
    first, last = crossed(origins, along, low - 1.0, low + np.array(volume.shape) + 1.0)
    near = np.flatnonzero(last >= first)
    first = np.clip(np.floor((first[near] - starts[near]) / increment) - 1, 0, counts[near]).astype(np.int64)
    last = np.clip(np.ceil((last[near] - starts[near]) / increment) + 2, 0, counts[near]).astype(np.int64)
    by = np.argsort(first - last, kind="stable")  # the lines of most samples first
    near, first, last = near[by], first[by], last[by]
    cells, stride = np.ascontiguousarray(volume).view(np.uint8).ravel(), (volume.shape[1] * volume.shape[2], volume.shape[2], 1)
    alone = (low == 0).all() and (volume.shape >= size).all()  # no other block holds any of the image
    changes, parts = 0, []
    for at in range(0, len(near), LINES):
        some, since, until = (x[at : at + LINES] for x in (near, first, last))
        going = np.searchsorted(since - until, -np.arange(int((until - since).max())))
        start, begin, places = starts[some], since.astype(float), np.ascontiguousarray(origins[some].T)
        none = np.uint8(2)
        begins, ends = np.full(len(some), none), np.full(len(some), none)  # of each line the first and the last phase in the block
        held, beyond = np.zeros(len(some), dtype=np.int64), np.zeros(len(some), dtype=bool)
        for k, n in enumerate(going.tolist()):
            way = begin[:n] + k
            way *= increment
            way += start[:n]
            index, good, own = 0, True, True
            for axis in range(3):
                place = way * along[axis]
                place += places[axis, :n]
                place = place.astype(np.int32)
                good = good & (place.view(np.uint32) < np.uint32(size[axis]))  # no less than 0, too
                if not alone:
                    place -= np.int32(low[axis])
                    own = own & (place.view(np.uint32) < np.uint32(volume.shape[axis]))
                if stride[axis] > 1:
                    place *= np.int32(stride[axis])
                index = index + place
            if alone:
                own = good
            else:
                own &= good
                beyond[:n] |= good != own
            index *= own
            phase = cells[index]
            changes += int(np.count_nonzero((phase != ends[:n]) & own))
            fresh = np.flatnonzero(own & (begins[:n] == none))
            begins[fresh], held[fresh] = phase[fresh], since[fresh] + k
            np.copyto(ends[:n], phase, where=own)
        met = begins != none
        changes -= int(met.sum())  # a line's first sample in the block is no change yet
        whole = met & (since == 0) & (until == counts[some]) & ~beyond
        changes += int((whole & (begins == 1)).sum())
        left = np.flatnonzero(met & ~whole)
        part = np.zeros(len(left), dtype=_PART)
        part["line"], part["first"], part["begins"], part["ends"] = some[left], held[left], begins[left] == 1, ends[left] == 1
        parts.append(part)
    return changes, np.concatenate(parts) if parts else np.zeros(0, dtype=_PART)


def border_changes(parts: np.ndarray) -> int:
    """Changes of phase where the parts of lines meet, and one for a line that begins in the foreground."""
    parts = parts[np.lexsort((parts["first"], parts["line"]))]
    before = np.concatenate(([False], parts["ends"][:-1])) & (np.diff(parts["line"], prepend=-1) == 0)
    return int((parts["begins"] != before).sum())


def mil_points(fg: DataFrame, shape: tuple[int, int, int], directions: int = 2000, lines: int = 10_000, increment: float = LEAST_INCREMENT, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(i, x, y, z): the mean intercept vector of each direction."""
    if directions < 9:
        raise ValueError("an ellipsoid needs nine directions")
    spark = fg.sparkSession
    length, sections = lines * float(np.linalg.norm(shape)), max(1, int(np.sqrt(lines)))
    increment = max(increment, LEAST_INCREMENT)
    grid = spark.range(-(-directions // CHUNK)).withColumnRenamed("id", "chunk")
    for k, n in zip("xyz", shape):
        grid = grid.withColumn(f"b{k}", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // block))))

    def run(batches):
        for b in batches:
            i_s, counts, lengths, left = [], [], [], []
            for chunk, place, data in zip(b.column(0).to_pylist(), zip(*(b.column(k).to_pylist() for k in (1, 2, 3))), b.column(4).to_pylist()):
                low = np.array(place) * block
                volume = np.zeros((block,) * 3, dtype=bool) if data is None else dense.unpacked(data, (block,) * 3, bool).transpose(2, 1, 0)
                for i in range(chunk * CHUNK, min(directions, (chunk + 1) * CHUNK)):
                    turn, rng = direction(seed, i)
                    *own, got = lines_of(shape, turn, rng, length, sections, increment)
                    changes, parts = block_changes(volume, low, shape, own, turn[:, 2], increment)
                    i_s.append(i)
                    counts.append(changes)
                    lengths.append(got)
                    left.append(parts.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(i_s, pa.int64()), pa.array(counts, pa.int64()), pa.array(lengths, pa.float64()), pa.array(left, pa.binary())], names=["i", "changes", "length", "parts"])

    def meet(key, f):
        turn, got = direction(seed, int(key[0]))[0], f.length.iloc[0]
        changes = int(f.changes.sum()) + border_changes(np.frombuffer(b"".join(f.parts), dtype=_PART))
        return pd.DataFrame([[key[0], *(turn[:, 2] * (got / max(1, changes)))]], columns=["i", "x", "y", "z"])

    held = grid.join(dense.blocks_of(fg.select("x", "y", "z"), [], None, block), ["bx", "by", "bz"], "left")
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    found = held.select("chunk", "bx", "by", "bz", "data").repartition(tasks, "chunk", "bx", "by", "bz").mapInArrow(run, "i bigint, changes bigint, length double, parts binary")
    return found.groupBy("i").applyInPandas(meet, "i bigint, x double, y double, z double")


def axis_intercepts(fg: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """keys and, along each axis over all lines of voxels: the changes of phase (nx, ny, nz; one for a line that begins in the foreground,
    none for where it ends in it) and the mean intercept length (mx, my, mz), exactly, by neighbours along the axis."""
    own = fg.select(*keys, *(F.col(k).cast("int").alias(k) for k in "xyz"))
    out, total = None, shape[0] * shape[1] * shape[2]
    for axis, n in zip("xyz", shape):
        before = F.lag(axis).over(Window.partitionBy(*keys, *(k for k in "xyz" if k != axis)).orderBy(axis))
        after = F.lead(axis).over(Window.partitionBy(*keys, *(k for k in "xyz" if k != axis)).orderBy(axis))
        rises = F.when(before == F.col(axis) - 1, 0).otherwise(1)
        falls = F.when((after == F.col(axis) + 1) | (F.col(axis) == n - 1), 0).otherwise(1)
        found = own.select(*keys, (rises + falls).alias("changes")).groupBy(*keys).agg(F.sum("changes").alias(f"n{axis}"))
        found = found.withColumn(f"m{axis}", F.lit(float(total)) / F.greatest(F.lit(1), F.col(f"n{axis}")))
        out = found if out is None else out.join(found, keys)
    return out


def anisotropy(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, da (0: isotropic, to 1), radii d1 <= d2 <= d3 and axes of the ellipsoid through the vectors."""
    e = fits.fit_ellipsoids(points, keys, strict=True)
    return e.select(*keys, (1 - F.col("ra") * F.col("ra") / (F.col("rc") * F.col("rc"))).alias("da"), F.col("ra").alias("d1"), F.col("rb").alias("d2"), F.col("rc").alias("d3"), *(f"v{i}{j}" for i in range(3) for j in range(3)))
