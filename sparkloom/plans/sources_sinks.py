"""Queries that write and read back: upserts, reaping, baselines, feeds, snapshots. Targets lie in spark.checkpoint.dir."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources import stores
from sparkloom.sources.tables import scoped, table

_CUT = "timestamp '1997-01-01'"


@query(
    """select source, lang, cast(count(*) as bigint) as n from documents where regexp_matches(source, '^src[0-9]$') and not regexp_matches(source, '^src[89]$') group by all"""
)
def scoped_scan(spark, d):
    """A scan within include and exclude patterns."""
    docs = scoped(table(spark, d, "documents"), "source", r"^src[0-9]$", r"^src[89]$")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select event_type, cast(count(*) as bigint) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k
from events where ts >= (select max(ts) from events) - interval 14 days group by 1"""
)
def recent_window(spark, d):
    """The last fourteen days of the feed, and a field of its JSON. The newest time is read first (Parquet's own statistics give it), so the bound
    is a literal that reaches the scan. A feed without times gives no rows."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    recent = e.where(F.col("ts") >= F.lit(last - timedelta(days=14)).cast(e.schema["ts"].dataType)) if last else e.limit(0)
    k = F.from_json("props", "k bigint")["k"]
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("select o_orderkey, o_orderdate from orders where o_orderstatus <> 'P' order by o_orderdate desc, o_orderkey desc limit 30")
def mainline_newest(spark, d):
    """The newest thirty orders of the main line."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30).select("o_orderkey", "o_orderdate")


@query("select l_partkey as part, max(l_shipdate) as newest from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1")
def newest_change(spark, d):
    """The newest change of each part in a window: the filter reaches the scan."""
    li = table(spark, d, "lineitem").where("l_shipdate >= timestamp '1998-01-01'")
    return li.groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_shipdate").alias("newest"))


@query(
    """select l_returnflag as kind, cast(sum(case when l_linestatus = 'O' then l_quantity else 0 end) as bigint) as added,
    cast(sum(case when l_linestatus = 'F' then l_quantity else 0 end) as bigint) as deleted,
    cast(sum(case when l_linestatus = 'O' then l_quantity else -l_quantity end) as bigint) as net from lineitem group by 1"""
)
def net_change(spark, d):
    """Added less deleted quantities."""
    add, cut = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    q = F.col("l_quantity")
    s = lambda c: F.sum(c).cast("bigint")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(
        s(F.when(add, q).otherwise(0)).alias("added"), s(F.when(cut, q).otherwise(0)).alias("deleted"), s(F.when(add, q).otherwise(-q)).alias("net")
    )


@query(
    """select o_orderkey % 16 as bucket, cast(count(*) as bigint) as n, max(o_totalprice) as dearest from (
    select o_orderkey, o_totalprice from orders where o_orderkey % 16 <> 3 or o_orderdate >= timestamp '1997-01-01') group by 1"""
)
def sink_upsert(spark, d):
    """Idempotent upsert: the touched key's partition is overwritten, the others stay; written twice, read once."""
    o = table(spark, d, "orders").withColumn("bucket", F.col("o_orderkey") % 16)
    path = stores.new_path(spark, "upsert")
    o.write.partitionBy("bucket").parquet(path)
    touched = o.where(f"bucket = 3 and o_orderdate >= {_CUT}")
    for _ in range(2):
        stores.overwrite_partitions(touched, path, "bucket")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("dearest"))


@query("select cast(count(*) as bigint) as kept, cast((select count(*) from orders) - count(*) as bigint) as reaped from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def sink_reap(spark, d):
    """Rows whose key has vanished go; the rest is written to a new version, and the pointer moves."""
    o = table(spark, d, "orders")
    seen = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    store = stores.Versions(spark, stores.new_path(spark, "reap"))
    store.put(o)
    store.put(store.get().join(seen, "o_orderkey", "left_semi"))
    kept = store.get().agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(o.agg(F.count(F.lit(1)).alias("n")), how="cross").select("kept", (F.col("n") - F.col("kept")).alias("reaped"))


@query("select o_custkey as k, cast(count(*) as bigint) as v, cast(nullif(count(*) filter (o_orderdate < timestamp '1997-01-01'), 0) as bigint) as was from orders group by 1")
def sink_baseline(spark, d):
    """A baseline written and compared; what it does not have stays null, apart from zero."""
    o = table(spark, d, "orders")
    count = lambda x, n: x.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    store = stores.Versions(spark, stores.new_path(spark, "baseline"))
    assert store.get() is None
    store.put(count(o.where(f"o_orderdate < {_CUT}"), "was"))
    now = count(o, "v").join(store.get(), "k", "left")
    return now.select("k", "v", "was")


@query("select event_type, cast(count(*) as bigint) as n, cast(count(distinct user_id) as bigint) as users from events group by 1")
def sink_json_report(spark, d):
    """A report as one JSON envelope a row, written as text and read back by its schema."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    path = stores.new_path(spark, "report")
    e.select(F.to_json(F.struct(F.lit("report/1").alias("schema"), F.struct("*").alias("body"))).alias("value")).write.text(path)
    row = F.from_json("value", "schema string, body struct<event_type string, n bigint, users bigint>")
    return spark.read.text(path).select(row.alias("r")).where("r.schema = 'report/1'").select("r.body.*")


@query("select l_shipdate as day, cast(count(*) as bigint) as n from lineitem where l_shipdate >= timestamp '1999-01-01' group by 1")
def index_scan_pruned(spark, d):
    """A snapshot partitioned by year, of which one scan reads the partitions asked for alone."""
    li = table(spark, d, "lineitem").select("l_shipdate").withColumn("year", F.year("l_shipdate"))
    path = stores.new_path(spark, "snapshot")
    li.repartition("year").write.partitionBy("year").parquet(path)
    return spark.read.parquet(path).where("year >= 1999").groupBy(F.col("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
