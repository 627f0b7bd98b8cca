"""Shards of a table in the order of an integer key, the same for the same rows in any run.

The key's span is cut into equal bins, and one grouped sum gives each bin's weight. A bin that outweighs a shard is cut anew
over the span of its own keys, and so on, so crowded ranges and far-out keys cost a pass more and no more. Neighbouring
bins are then joined into shards of about the wanted weight. The bins' sums alone reach the driver: BINS of the first cut,
and about 16 for each of at most MOST_SHARDS shards, beyond which shards grow with the input. Rows of one key stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 8192
MOST_SHARDS = 1 << 15
MOST_CUTS = 8


def _array(values: list[int], kind: str) -> Column:
    return F.expr(f"cast(array({','.join(map(str, values))}) as array<{kind}>)")


class _Cuts:
    """Cuts of spans of keys into equal bins. All bins have places in one list; a bin that is cut anew has its cut's number there, others 0."""

    def __init__(self, low: int, high: int):
        self.low, self.width, self.base, self.inner, self.depth = [], [], [], [], 0
        self.add(low, high, BINS)

    def add(self, low: int, high: int, bins: int) -> None:
        width = (high - low) // bins + 1
        self.low.append(low)
        self.width.append(width)
        self.base.append(len(self.inner))
        self.inner += [0] * ((high - low) // width + 1)

    def place(self, key: str) -> Column:
        """The place of the bin that holds a key; null for a null key."""
        low, width = self.low[0], self.width[0]
        if width * BINS >= 1 << 62:  # differences of such keys are beyond bigint
            at = F.expr(f"int((cast(`{key}` as decimal(20,0)) - {low}BD) div {width}BD)")
        else:
            at = F.expr(f"int((`{key}` - {low}L) div {width}L)")
        if not self.depth:
            return at
        # widths of inner cuts fit, as each is over a part of the first cut's bins
        lows, widths = _array(self.low, "bigint"), _array([min(w, 1 << 62) for w in self.width], "bigint")
        bases, inner = _array(self.base, "int"), _array(self.inner, "int")

        def step(at: Column, _: Column) -> Column:
            cut = F.element_at(inner, at + 1)
            down = F.element_at(bases, cut + 1) + F.call_function("div", F.col(key) - F.element_at(lows, cut + 1), F.element_at(widths, cut + 1)).cast("int")
            return F.when(cut > 0, down).otherwise(at)

        return F.when(F.col(key).isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), at, step))

    def in_order(self, cut: int = 0):
        """The places of all bins that aren't cut anew, by rising keys."""
        stop = self.base[cut + 1] if cut + 1 < len(self.base) else len(self.inner)
        for p in range(self.base[cut], stop):
            if self.inner[p]:
                yield from self.in_order(self.inner[p])
            else:
                yield p


def shard_plan(df: DataFrame, key: str, weight: Column, wanted: int) -> tuple[Column, int]:
    """The shard of a row (null keys are in the first), and the number of shards; shards ascend with the key."""
    span = df.agg(F.min(key).cast("decimal(38,0)").alias("low"), F.max(key).cast("decimal(38,0)").alias("high")).first()
    if span is None or span["low"] is None:
        return F.lit(0), 1
    cuts, weights, known, limit = _Cuts(int(span["low"]), int(span["high"])), {}, 0, None
    for _ in range(MOST_CUTS + 1):
        place = cuts.place(key)
        fresh = df.where(place.isNull() | (place >= known)) if known else df
        sums = fresh.groupBy(place.alias("place")).agg(F.sum(weight).alias("weight"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        weights |= {r["place"]: int(r["weight"] or 0) for r in sums}
        limit = limit or max(wanted, sum(weights.values()) // MOST_SHARDS)
        known, heavy = len(cuts.inner), sorted((r for r in sums if r["place"] is not None and (r["weight"] or 0) > limit and r["low"] < r["high"]), key=lambda r: r["place"])
        if not heavy:
            break
        cuts.depth += 1
        for r in heavy:
            cuts.inner[r["place"]] = len(cuts.low)
            cuts.add(r["low"], r["high"], min(BINS, 16 * weights.pop(r["place"]) // limit))
    shard_of, shard, held = [0] * len(cuts.inner), 0, weights.get(None, 0)
    for p in cuts.in_order():
        if held and held + weights.get(p, 0) > limit and weights.get(p):
            shard, held = shard + 1, 0
        held += weights.get(p, 0)
        shard_of[p] = shard
    if not shard:
        return F.lit(0), 1
    return F.coalesce(F.element_at(_array(shard_of, "int"), cuts.place(key) + 1), F.lit(0)), shard + 1
