"""Where to split a file: what each seam between two units saves against what it cuts, from running sums of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import exact


def running(rows: DataFrame, key: str, at: str, value: str, block: int = 4096) -> DataFrame:
    """(key, at, total): for each place, the sum of `value` over all places of its key up to it.

    Rows of one place are added before they are dealt out. Places fall into blocks of `block`, each summed by itself, so the rows of one key are sorted by
    many tasks; only a key's block sums meet.
    """
    slot = F.floor(F.col(at) / F.lit(block)).alias("_slot")
    sums = rows.groupBy(key, at).agg(F.sum(value).alias("_v")).select(key, at, "_v", slot)
    whole = sums.groupBy(key, "_slot").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("_v").over(Window.partitionBy(key, "_slot").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    base = whole.select(key, "_slot", F.coalesce(before, F.lit(0)).alias("_b"))
    return sums.withColumn("_in", inside).join(base, [key, "_slot"]).select(key, at, (F.col("_b") + F.col("_in")).cast("bigint").alias("total"))


def _spans(rows: DataFrame, low, high, price: int) -> DataFrame:
    steps = F.array(F.struct(low.cast("bigint").alias("at"), F.lit(price).alias("v")), F.struct(high.cast("bigint").alias("at"), F.lit(-price).alias("v")))
    return rows.select("file", F.inline(steps))


def split_gains(
    units: DataFrame, refs: DataFrame, clones: DataFrame, churn: DataFrame, soft: int = knobs.SOFT, hard: int = knobs.HARD, most: int = knobs.ZONE_MAX
) -> DataFrame:
    """(file, unit, benefit, cost, exempt): each file's best seam, the one after `unit`; a file whose best seam costs more than it saves is exempt, and so is one
    of a single unit (unit null, benefit and cost 0).

    `units` is (file, unit, end): units in ascending order and where each ends, ascending too; the last end is the file's size. `refs` and `churn` are (file, a, b),
    pairs of units; `clones` is (file, s, e), stretches from s to before e. A pair is severed by the seams after its first unit up to before its second one, a
    clone is cut by the seams that end in it: one step up and one down for each, added up by place, and a running sum gives every seam's cost. Benefit is how far the penalty of
    the size falls, in thousandths rounded down; the largest benefit / cost wins, the last of equals, compared to 19 decimal places (exact for costs below 10^9).
    Pairs of a unit with itself and empty stretches count nothing; rows with a null are left out.
    """
    units = units.dropna()
    size = units.groupBy("file").agg(F.max("end").alias("size"), F.max("unit").alias("last"))
    a, b = F.least("a", "b"), F.greatest("a", "b")
    none = lambda c: units.select("file", F.col(c).cast("bigint").alias("at"), F.lit(0).alias("v"))
    pairs = _spans(refs.dropna(), a, b, knobs.SPLIT_REF).unionByName(_spans(churn.dropna(), a, b, knobs.SPLIT_CHURN)).unionByName(none("unit"))
    cuts = _spans(clones.dropna().where("s < e"), F.col("s"), F.col("e"), knobs.SPLIT_CLONE).unionByName(none("end"))
    severed = running(pairs, "file", "at", "v").select("file", F.col("at").alias("unit"), F.col("total").alias("c1"))
    cut = running(cuts, "file", "at", "v").select("file", F.col("at").alias("end"), F.col("total").alias("c2"))
    width = hard - soft

    def penalty(x):
        over = x - soft
        return F.when(x <= soft, 0).when(x <= hard, over * over * most).otherwise((F.lit(width * width) + 2 * width * (x - hard)) * most)

    seams = units.join(size, "file").where("unit < last").join(severed, ["file", "unit"]).join(cut, ["file", "end"])
    falls = penalty(F.col("size")) - penalty(F.col("end")) - penalty(F.col("size") - F.col("end"))
    benefit = exact.whole(F.greatest(falls, F.lit(0)) * 1000, F.lit(width * width))
    priced = seams.select("file", "unit", benefit.alias("benefit"), (F.col("c1") + F.col("c2") + knobs.SPLIT_FILE).alias("cost"))
    ratio = F.col("benefit").cast("decimal(18,0)") / F.col("cost").cast("decimal(18,0)")
    best = priced.groupBy("file").agg(F.max(F.struct(ratio.alias("r"), "unit", "benefit", "cost")).alias("x"))
    out = size.select("file").join(best, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    exempt = F.col("x").isNull() | (F.col("x.benefit") < F.col("x.cost"))
    return out.select("file", F.col("x.unit").alias("unit"), zero("x.benefit").alias("benefit"), zero("x.cost").alias("cost"), exempt.alias("exempt"))
