"""Images as dense cubic blocks, and stencils over them with exchanged halos.

A sparse image (keys, x, y, z and perhaps a value) becomes rows (keys, bx, by, bz, data), a row a block of BLOCK^3 positions, as packed
bits or numbers in the order z, y, x. A stencil sends each of a block's 26 neighbours the layers that lie in that neighbour's halo; what
meets at a block (27 pieces at most) is one array, of which a function makes the block's new contents. So a task holds a block and its
halo, a voxel costs no rows of its own, and results are the same for any size of blocks. Blocks of fill alone aren't held.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
_AROUND = list(itertools.product((-1, 0, 1), repeat=3))
PLACE = ("bx", "by", "bz")


def _parts(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def packed(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes() if a.dtype == bool else a.tobytes()


def unpacked(data: bytes, shape: tuple[int, ...], dtype) -> np.ndarray:
    if dtype is bool:
        return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=int(np.prod(shape))).reshape(shape).astype(bool)
    return np.frombuffer(data, dtype=dtype).reshape(shape)


def blocks_of(voxels: DataFrame, keys: list[str], value: str | None = None, block: int = BLOCK, fill: float = 0.0) -> DataFrame:
    """(keys, bx, by, bz, data) of voxels; bits, or doubles of a column."""
    place = [F.floor(F.col(k) / block).cast("int").alias(f"b{k}") for k in "xyz"]
    own = voxels.select(*keys, *place, *(F.col(k).cast("int").alias(k) for k in "xyz"), *([F.col(value).cast("double").alias("v_")] if value else []))

    def run(t: pa.Table) -> pa.Table:
        a = np.full((block,) * 3, fill, dtype=np.float64) if value else np.zeros((block,) * 3, dtype=bool)
        x, y, z = (t.column(k).to_numpy() - block * t.column(f"b{k}")[0].as_py() for k in "xyz")
        a[z, y, x] = t.column("v_").to_numpy() if value else True
        one = [t.column(k).combine_chunks().slice(0, 1) for k in (*keys, *PLACE)]
        return pa.Table.from_arrays([*one, pa.array([packed(a)], pa.binary())], names=[*keys, *PLACE, "data"])

    return own.groupBy(*keys, *PLACE).applyInArrow(run, _parts(own, keys) + "bx int, by int, bz int, data binary")


def voxels_of(blocks: DataFrame, keys: list[str], value: str | None = None, block: int = BLOCK, fill: float = 0.0) -> DataFrame:
    """(keys, x, y, z[, value]) of the positions that aren't fill (NaN, too, can be fill)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                a = unpacked(b.column(len(keys) + 3)[i].as_py(), (block,) * 3, np.float64 if value else bool)
                held = a if not value else ~np.isnan(a) if np.isnan(fill) else a != fill
                z, y, x = np.nonzero(held)
                low = [block * b.column(len(keys) + k)[i].as_py() for k in range(3)]
                at = pa.array(np.full(len(x), i))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(keys))), *(pa.array((p + o).astype(np.int32)) for p, o in zip((x, y, z), low)), *([pa.array(a[held])] if value else [])], names=[*keys, "x", "y", "z", *([value] if value else [])])

    return blocks.select(*keys, *PLACE, "data").mapInArrow(run, _parts(blocks, keys) + "x int, y int, z int" + (f", `{value}` double" if value else ""))


def stencil(blocks: DataFrame, keys: list[str], halo: int, fn: Callable[[np.ndarray, tuple[int, int, int]], np.ndarray], dtype=bool, block: int = BLOCK, fill: float = 0.0, out_fill: float = 0.0) -> DataFrame:
    """(keys, bx, by, bz, data, changed): fn(array, (z, y, x) of its first position) of every block with its halo, without the halo;
    changed counts the positions that differ from before. Blocks that only a halo reaches are made, too; those of out_fill alone go."""
    if halo > block:
        raise ValueError("a halo is a block at most")
    size, empty = block + 2 * halo, False if dtype is bool else fill
    sent = {-1: slice(0, halo), 0: slice(0, block), 1: slice(block - halo, block)}
    put = {-1: slice(0, halo), 0: slice(halo, halo + block), 1: slice(halo + block, size)}
    names = [*keys, *PLACE]

    def send(batches):
        for b in batches:
            rows, target, source, data = [], [[], [], []], [], []
            for i in range(b.num_rows):
                a = unpacked(b.column(len(names))[i].as_py(), (block,) * 3, dtype)
                at = [b.column(len(keys) + k)[i].as_py() for k in range(3)]
                for n, (dz, dy, dx) in enumerate(_AROUND):
                    piece = a[sent[dz], sent[dy], sent[dx]]
                    if halo and (piece != empty).any() or dz == dy == dx == 0:
                        rows.append(i)
                        source.append(len(_AROUND) - 1 - n)  # the place of this block as that one sees it
                        data.append(packed(np.ascontiguousarray(piece)))
                        for k, d in enumerate((dx, dy, dz)):
                            target[k].append(at[k] + d)
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(which) for k in range(len(keys))), *(pa.array(t, pa.int32()) for t in target), pa.array(source, pa.int32()), pa.array(data, pa.binary())], names=[*names, "source", "data"])

    def meet(t: pa.Table) -> pa.Table:
        a = np.full((size,) * 3, empty, dtype=dtype)
        for s, data in zip(t.column("source").to_pylist(), t.column("data").to_pylist(), strict=True):
            where = tuple(put[d] for d in _AROUND[s])
            a[where] = unpacked(data, a[where].shape, dtype)
        low = tuple(block * t.column(k)[0].as_py() - halo for k in ("bz", "by", "bx"))
        inner = (slice(halo, halo + block),) * 3
        before = a[inner].copy()
        made = fn(a, low)[inner]
        changed = int((made != before).sum())
        held = made.any() if made.dtype == bool else (~np.isnan(made) if np.isnan(out_fill) else made != out_fill).any()
        rows = [t.column(k).combine_chunks().slice(0, int(held or changed > 0)) for k in names]
        return pa.Table.from_arrays([*rows, pa.array([packed(np.ascontiguousarray(made))] * len(rows[0]), pa.binary()), pa.array([changed] * len(rows[0]), pa.int64())], names=[*names, "data", "changed"])

    kinds = _parts(blocks, keys) + "bx int, by int, bz int, "
    pieces = blocks.select(*names, "data").mapInArrow(send, kinds + "source int, data binary")
    return pieces.groupBy(*names).applyInArrow(meet, kinds + "data binary, changed bigint")


# ---- the ball


def ball(radius: float) -> list[tuple[int, int, int]]:
    n = int(radius)
    return [o for o in itertools.product(range(-n, n + 1), repeat=3) if sum(c * c for c in o) <= radius * radius]


def outside(a: np.ndarray, low: tuple[int, int, int], shape: tuple[int, int, int]) -> np.ndarray:
    """Where positions of an array lie beyond the image of that shape (x, y, z)."""
    axes = [(np.arange(n) + o < 0) | (np.arange(n) + o >= most) for n, o, most in zip(a.shape, low, reversed(shape), strict=True)]
    return axes[0][:, None, None] | axes[1][:, None] | axes[2]


def over_ball(a: np.ndarray, radius: float, largest: bool, beyond: np.ndarray) -> np.ndarray:
    """Each position's largest or least value over the ball around it, without those beyond. Positions within the radius of the array's
    bounds get what is in the array. The ball is a stack of lines, so a line's running extremes serve all its places in the stack."""
    n = int(radius)
    worst = -np.inf if largest else np.inf
    op = np.maximum if largest else np.minimum
    source = np.pad(np.where(beyond, worst, a), n, constant_values=worst)
    out = np.full(a.shape, worst)
    lines = {0: source}
    for r in range(1, n + 1):  # extremes over x - r to x + r
        wide = lines[r - 1].copy()
        wide[:, :, r:] = op(wide[:, :, r:], source[:, :, :-r])
        wide[:, :, :-r] = op(wide[:, :, :-r], source[:, :, r:])
        lines[r] = wide
    for dz, dy in itertools.product(range(-n, n + 1), repeat=2):
        left = radius * radius - dz * dz - dy * dy
        if left >= 0:
            line = lines[int(np.sqrt(left) + 1e-9)]
            out = op(out, line[n + dz : n + dz + a.shape[0], n + dy : n + dy + a.shape[1], n : n + a.shape[2]])
    return out


def dilated(blocks: DataFrame, keys: list[str], shape: tuple[int, int, int], radius: float, largest: bool = True, block: int = BLOCK, fill: float = 0.0) -> DataFrame:
    """Blocks of doubles with each position's largest value over the ball (largest), or its least (an erosion). Positions that no block
    holds are fill; those beyond the image don't count."""

    def fn(a: np.ndarray, low) -> np.ndarray:
        beyond = outside(a, low, shape)
        return np.where(beyond, fill, over_ball(a, radius, largest, beyond))

    return stencil(blocks, keys, int(radius), fn, np.float64, block, fill, fill).drop("changed")
