"""Vectors of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256


def whole(vector: str, least: int, most: int, scale: int = SCALE) -> tuple[Column, Column]:
    """(whether a vector takes part, its components as floor(scale * x)).

    It takes part if no component is null, NaN, infinite or at least `most` / scale in size (so that sums of
    squares stay within a long), and if there are at least so many components.
    """
    bound = float(most) / scale
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & (x > -bound) & (x < bound))  # NaN is larger than any number
    return F.coalesce((F.size(v) >= least) & sound, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
