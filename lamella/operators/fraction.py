"""Element fraction: foreground and total size per subspace, and their ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.model import Axis, element_size, size_name, unit_header
from lamella.operators.filters import MASK


def element_fraction(voxels: DataFrame, keys: list[str], size: float = 1.0, total: int | None = None, value: str = "value") -> DataFrame:
    """keys, bv, tv, ratio of dense voxels (or of total voxels a subspace, for sparse ones): one partial aggregate."""
    fg = F.count_if(F.col(value) == MASK)
    n = F.count(F.lit(1)) if total is None else F.lit(total).cast("bigint")
    other = F.count_if(~F.col(value).isin(0, MASK))
    found = voxels.groupBy(*keys).agg(fg.alias("n_fg"), n.alias("n_all"), other.alias("n_other"))
    checked = F.when(F.col("n_other") > 0, F.raise_error(F.lit("the image is not a mask of 0 and 255")).cast("bigint")).otherwise(F.col("n_fg"))
    return found.select(*keys, (checked * size).alias("bv"), (F.col("n_all") * size).alias("tv"), (F.col("n_fg") / F.col("n_all")).alias("ratio"))


def headers(axes: list[Axis]) -> tuple[str, str, str]:
    s, unit = size_name(axes), unit_header(axes)
    return f"B{s} {unit}".strip(), f"T{s} {unit}".strip(), f"B{s}/T{s}"


def of_image(voxels: DataFrame, name: str, axes: list[Axis]) -> DataFrame:
    """(label, bv, tv, ratio) rows, labelled by 0-based channel and time."""
    found = element_fraction(voxels, ["t", "c"], element_size(axes)).orderBy("t", "c")
    label = F.concat(F.lit(name + " Channel: "), F.col("c").cast("string"), F.lit(", Time: "), F.col("t").cast("string"))
    return found.select(label.alias("label"), "bv", "tv", "ratio")
