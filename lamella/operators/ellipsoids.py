"""Ellipsoid factor: optimise ellipsoids at seeds, give each voxel its largest ellipsoids, and derive images from their radii.

Seeds are dealt by the block of the image that they lie in, and a task searches from many seeds at once in that block and the 26 around
it; seeds whose search leaves these are searched again in larger blocks, so that results don't depend on the blocks. Random numbers
follow from the seed's number. Voxels meet ellipsoids by blocks that the ellipsoids' boxes reach, and are ranked by volume.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import ellipsoid_bounds, ellipsoid_tensor
from lamella.operators import blocks as dense
from lamella.operators.filters import numbered
from lamella.storage import written

BLOCK = 16
COLUMNS = ["cx", "cy", "cz", "ra", "rb", "rc", *(f"v{i}{j}" for i in range(3) for j in range(3))]
#: Seeds that are searched at once, the fewest that a group is cut into, the angle of a turn by the contacts, and the rounds of one growth
#: or shrinkage.
BATCH, LEAST_BATCH, TURN, ROUNDS = 64, 8, 0.1, 1000


@dataclass(frozen=True)
class Parameters:
    """Step of radii, surface vectors, contacts that stop growth, iterations without gain, and drift from the seed; anchor: instead of
    drifting, an ellipsoid keeps the point of its surface that lies towards the seed."""

    increment: float = 1 / 2.3
    vectors: int = 100
    contacts: int = 1
    iterations: int = 100
    drift: float = 3**0.5
    anchor: bool = False


def _turned(axis: np.ndarray, angle: float) -> np.ndarray:
    x, y, z = axis / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _turns(axes: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Rotations about axes (n, 3); where an axis is zero, none."""
    length = np.linalg.norm(axes, axis=1, keepdims=True)
    unit = np.divide(axes, length, out=np.zeros_like(axes), where=length > 1e-12)
    k = np.zeros((len(axes), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -unit[:, 2], unit[:, 1], -unit[:, 0]
    k -= k.transpose(0, 2, 1)
    s, c = np.sin(angles)[:, None, None], (1 - np.cos(angles))[:, None, None]
    return np.eye(3) + s * k + c * (k @ k)


def torque(centre: np.ndarray, radii: np.ndarray, axes: np.ndarray, points: np.ndarray, touching: np.ndarray) -> np.ndarray:
    """The torque (n, 3) of unit forces on ellipsoids, inwards along the normals at those points (n, v, 3) that touch."""
    arm = points - centre[:, None]
    normal = np.einsum("nij,nvj->nvi", axes, np.einsum("nji,nvj->nvi", axes, arm) / (radii * radii)[:, None])
    length = np.linalg.norm(normal, axis=2, keepdims=True)
    force = np.divide(-normal, length, out=np.zeros_like(normal), where=length > 0)
    return (np.cross(arm, force) * touching[:, :, None]).sum(axis=1)


class Search:
    """Ellipsoids at many seeds in a volume (x, y, z of bool) whose first position is low, a part of an image. Each grows as a sphere until
    it touches background, is turned so that its first axis lies along its contacts, and grows along the others; then it is jiggled,
    bumped away from its contacts and turned by their torque in turn, shrunk until it fits and grown along an axis. The largest that fits
    is kept. lost: seeds whose search met positions of the image beyond the volume."""

    def __init__(self, volume: np.ndarray, low: np.ndarray, image: tuple[int, int, int], seeds: np.ndarray, ids: list[int], p: Parameters, seed: int = 0):
        self.volume, self.low, self.image, self.p = volume, np.asarray(low), np.array(image), p
        self.cells = volume.reshape(-1)
        self.seeds, n = seeds.astype(float), len(seeds)
        self.rngs = [np.random.default_rng([seed, int(i) & (1 << 63) - 1]) for i in ids]
        unit = np.stack([r.normal(size=(p.vectors, 3)) for r in self.rngs]) if n else np.zeros((0, p.vectors, 3))
        self.unit = unit / np.linalg.norm(unit, axis=2, keepdims=True)
        self.centre, self.radii, self.axes = self.seeds.copy(), np.full((n, 3), p.increment), np.tile(np.eye(3), (n, 1, 1))
        self.alive, self.lost = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)

    def surface(self, i: np.ndarray) -> np.ndarray:
        return self.centre[i][:, None] + np.einsum("nij,nvj->nvi", self.axes[i], self.unit[i] * self.radii[i][:, None])

    def contacts(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, touching) on the surfaces: points of the image that aren't foreground touch, those beyond it don't."""
        points = self.surface(i)
        at = np.floor(points).astype(np.int64)
        there = self._within(at, self.image)
        at -= self.low
        known = self._within(at, self.volume.shape)
        beyond = there & ~known
        if beyond.any():
            self.lost[i] |= beyond.any(axis=1)
        there &= known
        cell = (at[..., 0] * self.volume.shape[1] + at[..., 1]) * self.volume.shape[2] + at[..., 2]
        cell *= there
        there &= ~self.cells[cell]
        return points, there

    @staticmethod
    def _within(at: np.ndarray, size) -> np.ndarray:
        inside = at.view(np.uint64) < np.asarray(size, dtype=np.uint64)  # no less than 0, too
        return inside[..., 0] & inside[..., 1] & inside[..., 2]

    def _going(self, i: np.ndarray) -> np.ndarray:
        return i[self.alive[i] & ~self.lost[i]]

    def grow(self, i: np.ndarray, along: np.ndarray) -> None:
        """By an increment at a time along (n, 3), until there are enough contacts."""
        step = np.zeros_like(self.radii)
        step[i] = along * self.p.increment
        for _ in range(ROUNDS):
            i = self._going(i)
            if len(i):
                i = i[(self.contacts(i)[1].sum(axis=1) < self.p.contacts) & (self.radii[i].max(axis=1) < 2 * self.image.max())]
            if not len(i):
                return
            self.radii[i] += step[i]

    def shrink(self, i: np.ndarray) -> None:
        """Until there are too few contacts; what has no radius left is lost for good."""
        for _ in range(ROUNDS):
            i = self._going(i)
            if len(i):
                i = i[self.contacts(i)[1].sum(axis=1) >= self.p.contacts]
            if not len(i):
                return
            self.radii[i] -= self.p.increment / 4
            self.alive[i[self.radii[i].min(axis=1) <= 0]] = False

    def invalid(self, i: np.ndarray) -> np.ndarray:
        points = self.surface(i)
        out = ((points < 0) | (points >= self.image)).any(axis=2).mean(axis=1) > 0.5
        return out | (self.radii[i].prod(axis=1) * 4 / 3 * np.pi > self.image.prod())

    def _pin(self, i: np.ndarray, noise: np.ndarray):
        """Where surfaces lie towards the seeds, for anchored ellipsoids."""
        if not self.p.anchor:
            return None
        way = self.seeds[i] - self.centre[i]
        at_seed = np.linalg.norm(way, axis=1) <= 1e-12
        self.centre[i] += np.where(at_seed[:, None], 0.1 * noise, 0)
        way = np.einsum("nji,nj->ni", self.axes[i], self.seeds[i] - self.centre[i]) / self.radii[i]
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        return way, self._towards(i, way)

    def _towards(self, i: np.ndarray, way: np.ndarray) -> np.ndarray:
        return self.centre[i] + np.einsum("nij,nj->ni", self.axes[i], self.radii[i] * way)

    def _unpin(self, i: np.ndarray, pin) -> None:
        if pin is not None:
            self.centre[i] += pin[1] - self._towards(i, pin[0])

    def _turn(self, i: np.ndarray, axes: np.ndarray, angles: np.ndarray) -> None:
        self.axes[i] = _turns(axes, angles) @ self.axes[i]

    def jiggle(self, i: np.ndarray, draw: np.ndarray) -> None:
        self._turn(i, draw[:, :3] - 0.5, (draw[:, 3] - 0.5) * 2 * TURN)

    def bump(self, i: np.ndarray, draw: np.ndarray) -> None:
        """Away from the mean of the contacts, no further from the seed than the drift; without contacts, a jiggle."""
        points, touching = self.contacts(i)
        away = -((points - self.centre[i][:, None]) * touching[:, :, None]).sum(axis=1)
        length = np.linalg.norm(away, axis=1, keepdims=True)
        to = self.centre[i] + np.divide(away, length, out=np.zeros_like(away), where=length > 0) * self.p.increment * draw[:, :1]
        near = self.p.anchor | (np.linalg.norm(to - self.seeds[i], axis=1) <= self.p.drift)
        self.centre[i] = np.where(near[:, None], to, self.centre[i])
        none = ~touching.any(axis=1)
        self.jiggle(i[none], draw[none])

    def turn(self, i: np.ndarray, draw: np.ndarray) -> None:
        points, touching = self.contacts(i)
        self._turn(i, torque(self.centre[i], self.radii[i], self.axes[i], points, touching), np.full(len(i), TURN))

    def begin(self) -> None:
        i = np.arange(len(self.seeds))
        noise = np.stack([r.normal(size=3) for r in self.rngs])
        pin = self._pin(i, noise)
        self.grow(i, np.ones((len(i), 3)))
        self._unpin(i, pin)
        points, touching = self.contacts(i)
        short = ((points - self.centre[:, None]) * touching[:, :, None]).sum(axis=1)
        short = np.where(np.linalg.norm(short, axis=1, keepdims=True) > 1e-9, short, [1.0, 0, 0])
        short /= np.linalg.norm(short, axis=1, keepdims=True)
        least = np.eye(3)[np.abs(short).argmin(axis=1)]
        middle = np.cross(short, least)
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
        self.axes = np.stack([short, middle, np.cross(short, middle)], axis=2)
        self.shrink(i)
        i = self._going(i)
        self.grow(i, np.tile([0.0, 1, 1], (len(i), 1)))
        self.shrink(i)

    def run(self) -> list[tuple | None]:
        """(centre, radii, axes), radii rising, of each seed; None where there is none, or the search is lost."""
        if not len(self.seeds):
            return []
        self.begin()
        i = self._going(np.arange(len(self.seeds)))
        self.alive[i[self.invalid(i)]] = False
        best = [self.centre.copy(), self.radii.copy(), self.axes.copy()]
        since, total = np.zeros(len(self.seeds), dtype=int), 0
        searching = self._going(np.arange(len(self.seeds)))
        while len(searching) and total < 10 * self.p.iterations:
            total += 1
            before = best[1][searching].prod(axis=1)
            for change in (self.jiggle, self.bump, self.turn):
                i = searching[~self.lost[searching]]
                draw = np.stack([self.rngs[k].random(8) for k in i]) if len(i) else np.zeros((0, 8))
                self.alive[i] = True
                pin = self._pin(i, draw[:, 5:8] - 0.5)
                change(i, draw)
                self._unpin(i, pin)
                self.shrink(i)
                g = self._going(i)
                axis = np.minimum(2, (draw[np.searchsorted(i, g), 4] * 3).astype(int))
                self.grow(g, np.eye(3)[axis])
                self.shrink(g)
                g = self._going(g)
                g = g[~self.invalid(g) & (self.radii[g].prod(axis=1) > best[1][g].prod(axis=1))]
                for held, now in zip(best, (self.centre, self.radii, self.axes)):
                    held[g] = now[g]
                back = np.setdiff1d(i, g) if change == self.turn else i[~self.alive[i]]
                self.centre[back], self.radii[back], self.axes[back] = (x[back] for x in best)
                self.alive[i] = True
            gained = best[1][searching].prod(axis=1) > before * (1 + 1e-3)
            since[searching] = np.where(gained, 0, since[searching] + 1)
            searching = searching[(since[searching] < self.p.iterations) & ~self.lost[searching]]
        out = []
        for k in range(len(self.seeds)):
            order = np.argsort(best[1][k])
            out.append((best[0][k], best[1][k][order], best[2][k][:, order]) if self.alive[k] and not self.lost[k] else None)
        return out


def _searched(seeds: DataFrame, held: DataFrame, shape: tuple[int, int, int], block: int, parameters: Parameters, seed: int) -> DataFrame:
    """(seed_id, x, y, z, lost, COLUMNS) of seeds, each in its block and those around it; held are the image's blocks. Few seeds are dealt in
    smaller groups, so that all cores search."""
    cores = seeds.sparkSession.sparkContext.defaultParallelism
    batch = max(LEAST_BATCH, min(BATCH, -(-seeds.count() // (2 * cores))))
    around = list(itertools.product((-1, 0, 1), repeat=3))
    own = seeds.select("seed_id", "x", "y", "z", *(F.floor(F.col(k) / block).cast("int").alias(f"b{k}") for k in "xyz"))
    groups = own.groupBy(*dense.PLACE).agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("groups"))
    own = own.join(groups, list(dense.PLACE)).select("seed_id", "x", "y", "z", *dense.PLACE, F.expr("int(pmod(xxhash64(seed_id), groups))").alias("group"))
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{k}") for k, v in zip("xyz", o))) for o in around)))
    sent = held.select(near.alias("o"), *dense.PLACE, "data").select(*((F.col(f"b{k}") + F.col(f"o.o{k}")).alias(f"b{k}") for k in "xyz"), *((-F.col(f"o.o{k}")).alias(f"o{k}") for k in "xyz"), "data")
    sent = sent.join(groups, list(dense.PLACE)).select(*dense.PLACE, "ox", "oy", "oz", "data", F.expr("explode(sequence(0, groups - 1))").alias("group"))
    columns = ["seed_id", "x", "y", "z", "lost", *COLUMNS]

    def run(f: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(f):
            volume = np.zeros((3 * block,) * 3, dtype=bool)
            for ox, oy, oz, data in pieces[["ox", "oy", "oz", "data"]].itertuples(index=False):
                x, y, z = ((o + 1) * block for o in (ox, oy, oz))
                volume[x : x + block, y : y + block, z : z + block] = dense.unpacked(data, (block,) * 3, bool).transpose(2, 1, 0)
            low = (f[["bx", "by", "bz"]].iloc[0].to_numpy(dtype=int) - 1) * block
            f = f.sort_values("seed_id")
            for at in range(0, len(f), BATCH):
                some = f.iloc[at : at + BATCH]
                search = Search(volume, low, shape, some[["x", "y", "z"]].to_numpy(), some.seed_id.tolist(), parameters, seed)
                for row, found, lost in zip(some[["seed_id", "x", "y", "z"]].itertuples(index=False), search.run(), search.lost.tolist()):
                    if lost or found:
                        out.append([*row, lost, *((*found[0], *found[1], *found[2].ravel()) if found else [None] * len(COLUMNS))])
        return pd.DataFrame(out, columns=columns)

    by = [*dense.PLACE, "group"]
    tasks = max(2 * cores, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own, sent = (t.repartition(tasks, *by) for t in (own, sent))  # small rows, long searches: not to be coalesced
    return own.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(run, "seed_id bigint, x double, y double, z double, lost boolean, " + ", ".join(f"{c} double" for c in COLUMNS))


def optimise(seeds: DataFrame, fg: DataFrame, shape: tuple[int, int, int], parameters: Parameters = Parameters(), seed: int = 0, block: int = dense.BLOCK) -> DataFrame:
    """(ell_id, COLUMNS) of the seeds (seed_id, x, y, z) for which an ellipsoid was found; ids rise as volumes fall."""
    left, parts = seeds, []
    while True:
        found = written(_searched(left, dense.blocks_of(fg.select("x", "y", "z"), [], None, block), shape, block, parameters, seed), "searched")
        parts.append(found.where("not lost").select("seed_id", *COLUMNS))
        left = found.where("lost").select("seed_id", "x", "y", "z")
        if left.isEmpty():
            break
        block *= 2  # blocks that hold all of the image lose no search
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return ranked(out)


def ranked(found: DataFrame) -> DataFrame:
    """Numbered from 0 in the order of falling volume; of equal ones by their seeds."""
    return numbered(found, [(F.col("ra") * F.col("rb") * F.col("rc")).desc(), F.col("seed_id")], "ell_id").withColumn("ell_id", F.col("ell_id").cast("int"))


def with_tensors(ellipsoids: DataFrame) -> DataFrame:
    """With the six parts of the quadratic form (t00 .. t22) and half the sides of the box (hx, hy, hz)."""
    names = ["t00", "t01", "t02", "t11", "t12", "t22", "hx", "hy", "hz"]

    def run(frames):
        for f in frames:
            rows = []
            for r in f[COLUMNS].to_numpy(dtype=float):
                radii, axes = r[3:6], r[6:].reshape(3, 3)
                t = ellipsoid_tensor(radii, axes)
                rows.append([t[0, 0], t[0, 1], t[0, 2], t[1, 1], t[1, 2], t[2, 2], *ellipsoid_bounds(radii, axes)])
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in ellipsoids.schema.fields), *(f"{n} double" for n in names)])
    return ellipsoids.mapInPandas(run, schema)


def _held(fg: DataFrame, tensors: DataFrame, block: int, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels and the ellipsoids of their subspace (keys) that hold their centres; they meet by the blocks that an ellipsoid's box reaches."""
    e = tensors
    for k in "xyz":
        e = e.withColumn(f"b{k}", F.explode(F.sequence(F.floor((F.col(f"c{k}") - F.col(f"h{k}")) / block), F.floor((F.col(f"c{k}") + F.col(f"h{k}")) / block))))
    own = fg.select(*keys, "x", "y", "z", *(F.floor(F.col(k) / block).alias(f"b{k}") for k in "xyz"))
    d = [F.col(k) + 0.5 - F.col(f"c{k}") for k in "xyz"]
    form = F.col("t00") * d[0] * d[0] + F.col("t11") * d[1] * d[1] + F.col("t22") * d[2] * d[2] + 2 * (F.col("t01") * d[0] * d[1] + F.col("t02") * d[0] * d[2] + F.col("t12") * d[1] * d[2])
    near = F.lit(True)
    for i, k in enumerate("xyz"):
        near = near & (F.abs(d[i]) <= F.col(f"h{k}"))
    return own.join(e, [*keys, "bx", "by", "bz"]).where(near).where(form <= 1)


def painted(voxels: DataFrame, tensors: DataFrame, block: int = BLOCK, keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, z, n: how many ellipsoids hold each voxel that any holds."""
    return _held(voxels, tensors, block, keys).groupBy(*keys, "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


def assign(fg: DataFrame, tensors: DataFrame, n: int = 1, block: int = BLOCK, keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, z, rank, ell_id, ra, rb, rc: the n largest ellipsoids that hold each voxel's centre, rank 0 the largest."""
    held = _held(fg, tensors, block, keys)
    order = Window.partitionBy(*keys, "x", "y", "z").orderBy("ell_id")
    return held.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n).select(*keys, "x", "y", "z", "rank", "ell_id", "ra", "rb", "rc")


def id_image(fg: DataFrame, assigned: DataFrame, n: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, z, rank, ell_id of every foreground voxel for each rank below n: which ellipsoid it is in, -1 where there is none."""
    every = fg.select(*keys, "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rank"))
    by = [*keys, "x", "y", "z", "rank"]
    return every.join(assigned.select(*by, "ell_id"), by, "left").withColumn("ell_id", F.coalesce("ell_id", F.lit(-1)))


def factor_image(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, z and the volume-weighted means over a voxel's ellipsoids: ef (a/b - b/c), ra, rb, rc, a_b, b_c, volume."""
    v = F.col("ra") * F.col("rb") * F.col("rc") * (4 * np.pi / 3)
    made = {"ef": F.col("ra") / F.col("rb") - F.col("rb") / F.col("rc"), "ra": F.col("ra"), "rb": F.col("rb"), "rc": F.col("rc"), "a_b": F.col("ra") / F.col("rb"), "b_c": F.col("rb") / F.col("rc")}
    return assigned.groupBy(*keys, "x", "y", "z").agg(*((F.sum(x * v) / F.sum(v)).alias(k) for k, x in made.items()), (F.sum(v) / F.count(F.lit(1))).alias("volume"))


def statistics(image: DataFrame, foreground: int | DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, median, max and min of ef, and the percentage of the foreground (a count, or its voxels) that has one."""
    made = [F.median("ef").alias("median"), F.max("ef").alias("max"), F.min("ef").alias("min"), F.count("ef").alias("n_")]
    found = image.groupBy(*keys).agg(*made) if keys else image.agg(*made)
    if isinstance(foreground, int):
        found = found.withColumn("all_", F.lit(foreground))
    elif keys:
        found = found.join(foreground.groupBy(*keys).agg(F.count(F.lit(1)).alias("all_")), list(keys))
    else:
        found = found.withColumn("all_", F.lit(foreground.count()))
    return found.withColumn("filling", F.col("n_") * 100.0 / F.col("all_")).drop("n_", "all_")


def unweighted_flinn(ellipsoids: DataFrame, bins: int = 512, keys: Sequence[str] = ()) -> DataFrame:
    """keys, col, row of the Flinn plot that any ellipsoid falls in, whatever its voxels."""
    return flinn(ellipsoids.select(*keys, (F.col("rb") / F.col("rc")).alias("b_c"), (F.col("ra") / F.col("rb")).alias("a_b")), bins, keys).drop("n")


def flinn_peaks(assigned: DataFrame, bins: int = 512, keys: Sequence[str] = ()) -> DataFrame:
    """The Flinn peak plot: how many voxels have an ellipsoid of each place as their largest."""
    return flinn(assigned.where("rank = 0").select(*keys, (F.col("rb") / F.col("rc")).alias("b_c"), (F.col("ra") / F.col("rb")).alias("a_b")), bins, keys)


def flinn(image: DataFrame, bins: int = 512, keys: Sequence[str] = ()) -> DataFrame:
    """The Flinn plot: keys, and voxels by (b/c, a/b), the second from the top."""
    near = 0.5 + 1e-9  # ratios that differ in their last digits alone fall into the same bin
    col = F.floor(F.col("b_c") * (bins - 1) + near).cast("int")
    row = (bins - 1 - F.floor(F.col("a_b") * (bins - 1) + near)).cast("int")
    return image.groupBy(*keys, col.alias("col"), row.alias("row")).agg(F.count(F.lit(1)).alias("n"))


def run_average(runs: DataFrame, count: int, value: str = "ef", keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, z and the mean of so many runs (run from 1; a voxel without a value has no row in a run). A voxel's sum is folded over the
    runs: where the sum so far or the run n has a value and the other hasn't, it becomes sum (1 + 1 / (n - 1)) or value * n."""
    steps = F.array_sort(F.collect_list(F.struct("run", F.col(value).alias("v"))))
    held = runs.groupBy(*keys, "x", "y", "z").agg(F.map_from_entries(steps).alias("of"))

    def fold(total: Column, n: Column) -> Column:
        own = F.get(F.map_values(F.map_filter("of", lambda k, _: k == n)), F.lit(0))
        added = F.when(own.isNull(), total * (1 + F.lit(1.0) / (n - 1))).otherwise(total + own)
        return F.when(total.isNull(), own * n).otherwise(added)

    return held.select(*keys, "x", "y", "z", (F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.lit(None).cast("double"), fold) / count).alias(value))


def seeds(*found: DataFrame) -> DataFrame:
    """All seeds of several searches (x, y, z), repeats included, numbered in order of the searches and of their places."""
    every = None
    for i, f in enumerate(found):
        own = f.select(F.lit(i).alias("search"), *(F.col(k).cast("double").alias(k) for k in "xyz"))
        every = own if every is None else every.unionByName(own)
    return every


def convergence(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, mean, max, min and upper median of how far an image moved, where both have values."""
    by = [*keys, "x", "y", "z"]
    moved = before.select(*by, F.col("ef").alias("p")).join(after.select(*by, F.col("ef").alias("q")), by).select(*keys, F.abs(F.col("p") - F.col("q")).alias("d"))
    return moved.groupBy(*keys).agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.min("d").alias("min"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC)").alias("median"))
