"""Exact selection by cumulated counts: medians without sorting a group's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import exact


def middles(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, order..., times, total): the middle value of each key's rows, or the middle two, and how many of the middle places (one or two) each takes.

    Rows are counted by key and value before they are dealt out, and places come from running sums of those counts, so a group of any size is as many rows as it
    has different values. Rows with a null value have no place.
    """
    counted = rows.dropna(subset=order).groupBy(key, *order).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(*order)
    last = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("last", last).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    low, high = exact.whole(F.col("total") + 1, F.lit(2)), exact.whole(F.col("total") + 2, F.lit(2))
    first = F.col("last") - F.col("n")
    holds = lambda p: ((first < p) & (p <= F.col("last"))).cast("bigint")
    # one place counts once where low and high are the same
    times = holds(low) + F.when(high != low, holds(high)).otherwise(F.lit(0).cast("bigint"))
    return placed.withColumn("times", times).where("times > 0").select(key, *order, "times", "total")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, top, bottom): the median of whole numbers as a ratio, the sum of the middle one or two over their number."""
    return middles(rows, key, [value]).groupBy(key).agg(F.sum(F.col(value) * F.col("times")).cast("bigint").alias("top"), F.sum("times").alias("bottom"))


def soft_lines(rows: DataFrame, key: str, value: str, exponent: int, low: int, high: int) -> DataFrame:
    """(key, soft): floor(m r^k) of each key's positive whole numbers, kept between `low` and `high`; m is their median and r the median of each one's ratio to it, folded to 1 or more.

    All in whole numbers of up to 38 digits: values below 10^5 with an exponent of 2 fit. A key without positive values has no line.
    """
    some = rows.where(F.col(value) > 0).select(key, F.col(value).cast("bigint").alias("v"))
    m = medians(some, key, "v")
    scaled = some.join(m, key).withColumn("x", F.col("v") * F.col("bottom"))
    ratios = scaled.select(key, F.greatest("x", "top").alias("p"), F.least("x", "top").alias("q"))
    # the order of ratios: 20 digits tell two of them with parts below 10^9 apart
    keyed = ratios.withColumn("r", (F.col("p").cast("decimal(18,0)") / F.col("q").cast("decimal(18,0)")).cast("decimal(38,20)"))
    mid = middles(keyed, key, ["r", "p", "q"]).select(key, "p", "q", "times")
    # equal ratios with other parts are one value: of those the first counts for the place it has
    first = mid.groupBy(key).agg(F.min(F.struct(F.col("times"), "p", "q")).alias("a"), F.max(F.struct(F.col("times"), "p", "q")).alias("b"), F.sum("times").alias("t"))
    big = lambda c: c.cast("decimal(38,0)")
    # of one middle value it is p / q; of two, (p q' + p' q) / 2 q q'
    one = F.col("a") == F.col("b")
    top = F.when(one, big(F.col("a.p"))).otherwise(big(F.col("a.p")) * F.col("b.q") + big(F.col("b.p")) * F.col("a.q"))
    bottom = F.when(one, big(F.col("a.q"))).otherwise(big(F.col("a.q")) * F.col("b.q") * 2)
    spread = first.select(key, big(top).alias("rt"), big(bottom).alias("rb")).join(m, key)
    up, down = big(F.col("top")), big(F.col("bottom"))
    for _ in range(exponent):
        up, down = big(up * F.col("rt")), big(down * F.col("rb"))
    line = F.call_function("div", up, down)
    return spread.select(key, F.least(F.greatest(line, F.lit(low).cast("bigint")), F.lit(high).cast("bigint")).alias("soft"))
