"""Structured Streaming forms: warn-once, incremental refresh, windows, sessions, stream-static gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources import stores


def stream_of(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, in the table's schema. A pattern that only this name fits stands for a table that is one file; neighbours are not read."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run until all input there is has been taken, into Parquet; then read that. Aggregates are finished by a watermark or a complete table."""
    spark = stream.sparkSession
    out, state = stores.new_path(spark, f"{name}-out"), stores.new_path(spark, f"{name}-state")
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", out)
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/b{number}")

        sink = stream.writeStream.foreachBatch(replace)
    query = sink.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    done = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{out}/b{done}")


def each_batch(stream: DataFrame, name: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """foreachBatch to the end of the input."""
    state = stores.new_path(stream.sparkSession, f"{name}-state")
    query = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def whole_delay(rows: DataFrame, when: str) -> str:
    """A watermark delay under which no row of the table is late, whatever the number and order of its files: newest less oldest, and a second."""
    at = F.col(when).cast("timestamp")
    span = rows.agg(F.unix_seconds(F.max(at)) - F.unix_seconds(F.min(at))).first()[0]
    return f"{(span or 0) + 1} seconds"


def warn_once(events: DataFrame, keys: list[str], when: str, delay: str) -> DataFrame:
    """The first event of each key; repeats within the watermark are dropped by keyed state."""
    return events.withWatermark(when, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, when: str, delay: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """start, keys, n, cents: counts and sums by window; events later than `delay` are left out. Times without a zone are read in the session's."""
    w = F.window(when, width, slide) if slide else F.window(when, width)
    timed = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, delay)
    counted = timed.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return counted.select(F.col("w.start").cast(events.schema[when].dataType).alias("start"), *keys, "n", "cents")


def upserted(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregate in update mode to the end of the input: a batch writes the groups that it changed, and of each group the newest row counts.

    A batch that is run again replaces what it wrote; state that the watermark has passed is dropped, and no batch writes the whole result again.
    """
    spark = stream.sparkSession
    out = stores.new_path(spark, f"{name}-out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    each_batch(stream, name, write, "update")
    rest = [c for c in stream.columns if c not in keys]
    every = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("newest"))
    return newest.select(*keys, "newest.*")


def refreshed(stream: DataFrame, name: str, key: str, content: str, buckets: int = 16) -> DataFrame:
    """The newest row of each key. A batch has a key once.

    `content` is a hash of what a row stands for: rows whose stored hash is the same are left alone, and a batch rewrites the buckets of changed keys only. A batch
    without changes, such as one that is run again, writes nothing.
    """
    spark = stream.sparkSession
    path = stores.new_path(spark, name)

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
        if number:
            old = spark.read.parquet(path)
            was = old.select(F.col(key).alias("k"), F.col(content).alias("was"), F.lit(True).alias("known"))
            changed = new.join(was, F.col(key).eqNullSafe(F.col("k")), "left").where(F.col("known").isNull() | ~F.col(content).eqNullSafe(F.col("was")))
            changed = stores.written(changed.select(new.columns), f"{name}-changed")
            if changed.isEmpty():
                return
            stay = old.join(changed.select(key), old[key].eqNullSafe(changed[key]), "left_anti").join(changed.select("bucket").distinct(), "bucket", "left_semi")
            # a table is not overwritten while it is read
            new = stores.written(changed.unionByName(stay.select(new.columns)), f"{name}-step")
        stores.overwrite_partitions(new, path, "bucket")

    each_batch(stream, name, upsert)
    out = spark.read.parquet(path).drop("bucket")
    out._loom_path = path
    return out
