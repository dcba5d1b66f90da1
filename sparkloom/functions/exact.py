"""Integer and rational arithmetic: decisions never rest on floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(a: Column, b: Column) -> Column:
    """a div b, rounded towards zero, in whole numbers; b is not zero."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def at_least(part: Column, total: Column, num: int, den: int) -> Column:
    """part / total >= num / den, cross-multiplied."""
    return part * F.lit(den) >= total * F.lit(num)


def charge(scale: int, value: Column, rest: Column) -> Column:
    """floor(scale * v / (v + n)); nothing is charged where both are zero."""
    return F.when(value + rest > 0, whole(F.lit(scale) * value, value + rest)).otherwise(F.lit(0).cast("bigint"))


def tsallis_permille(total: Column, squares: Column, bins: Column) -> Column:
    """Normalised Tsallis-2 diversity of counts, in thousandths, rounded down; one bin has none."""
    top = F.lit(1000) * (total * total - squares) * bins
    return F.when(bins <= 1, F.lit(0).cast("bigint")).otherwise(whole(top, total * total * (bins - 1)))
