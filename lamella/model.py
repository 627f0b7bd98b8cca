"""The data model: calibrated axes, units, subspace labels, result headers and checks.

Voxels are a relation (image_id, t, c, z, y, x, value) with 0-based positions; a channel or a time is a grouping key and never
a split. Sparse tables hold the foreground alone. Axes are metadata of an image.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPATIAL = ("X", "Y", "Z")
#: Metres in each unit of length.
METRES = {"nm": 1e-9, "um": 1e-6, "µm": 1e-6, "μm": 1e-6, "micron": 1e-6, "mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1e3, "inch": 0.0254, "in": 0.0254}
EXPONENTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


@dataclass(frozen=True)
class Axis:
    """One axis of an image; linear says that its scale is the same all along."""

    kind: str
    size: int = 1
    scale: float = 1.0
    unit: str | None = None
    origin: float = 0.0
    linear: bool = True


class InvalidImage(ValueError):
    """An image that a measurement can't take."""


def spatial(axes: Iterable[Axis]) -> list[Axis]:
    return [a for a in axes if a.kind in SPATIAL]


def count_spatial(axes: Iterable[Axis] | None) -> int:
    return len(spatial(axes or ()))


def has_kind(axes: Iterable[Axis] | None, kind: str) -> bool:
    return any(a.kind == kind for a in axes or ())


def axis_index(axes: list[Axis], kind: str) -> int:
    return next((i for i, a in enumerate(axes) if a.kind == kind), -1)


def _unit(unit: str | None) -> str:
    return (unit or "").replace("µ", "u").replace("μ", "u")


def spatial_unit(axes: list[Axis]) -> str | None:
    """The first spatial axis's unit; "" if none has one; None if they can't be converted into each other."""
    own = spatial(axes)
    if not own:
        raise ValueError("an image without spatial axes has no unit")
    if not any(a.unit for a in own):
        return ""
    if any(not a.unit for a in own) or any(_unit(a.unit) not in METRES for a in own) and len({_unit(a.unit) for a in own}) > 1:
        return None
    return own[0].unit


def conversion(from_unit: str, to_unit: str) -> float:
    """How many of to_unit one from_unit is; NaN if that can't be told."""
    a, b = METRES.get(_unit(from_unit)), METRES.get(_unit(to_unit))
    return 1.0 if _unit(from_unit) == _unit(to_unit) else a / b if a and b else math.nan


def element_size(axes: list[Axis]) -> float:
    """The size of one element in the first spatial axis's unit; NaN where units don't convert or a scale isn't linear."""
    own, unit = spatial(axes), spatial_unit(axes)
    if unit is None or not all(a.linear for a in own):
        return math.nan
    return math.prod(a.scale * (conversion(a.unit, unit) if unit else 1.0) for a in own)


def anisotropy(axes: list[Axis]) -> float:
    """The largest scale over the smallest, less one."""
    scales = [a.scale for a in spatial(axes)]
    return 0.0 if len(scales) < 2 else math.inf if min(scales) <= 0 else max(scales) / min(scales) - 1


def is_isotropic(axes: list[Axis], tolerance: float = 0.0) -> bool:
    if not tolerance >= 0:
        raise ValueError("a tolerance is a number from 0 on")
    return anisotropy(axes) - tolerance <= 1e-12


def exponent(dimensions: int) -> str:
    return EXPONENTS[dimensions] if 2 <= dimensions <= 9 else ""


def unit_header(axes: list[Axis], with_exponent: bool = True) -> str:
    unit = spatial_unit(axes)
    return f"({unit}{exponent(count_spatial(axes)) if with_exponent else ''})" if unit else ""


def size_name(axes: list[Axis]) -> str:
    return {2: "A", 3: "V"}.get(count_spatial(axes), "Size")


def subspace_label(name: str, c: int | None = None, t: int | None = None, z: int | None = None) -> str:
    """name with the 1-based positions of its channel, slice and time."""
    parts = [f"{what}: {v + 1}" for what, v in (("Slice", z), ("Channel", c), ("Time", t)) if v is not None]
    return f"{name} {', '.join(parts)}".strip()


def label_column(name: str, c: Column, t: Column) -> Column:
    return F.concat(F.lit(name + " Channel: "), (c + 1).cast("string"), F.lit(", Time: "), (t + 1).cast("string"))


def validate(axes: list[Axis], dimensions: int | None = 3, binary: bool | None = None, hyperstack: bool = True) -> None:
    """Raises InvalidImage with the reason."""
    if not axes:
        raise InvalidImage("no image")
    if dimensions and count_spatial(axes) != dimensions:
        raise InvalidImage(f"the image needs {dimensions} spatial dimensions")
    if binary is False:
        raise InvalidImage("the image is not binary")
    if not hyperstack and (has_kind(axes, "CHANNEL") or has_kind(axes, "TIME")):
        raise InvalidImage("the image has channels or times")


def subspaces(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct subspaces of a hyperstack by their keys, in the order of the outermost first, numbered from 0."""
    from pyspark.sql import Window

    return voxels.select(*keys).distinct().withColumn("subspace", F.row_number().over(Window.orderBy(*keys)) - 1)
