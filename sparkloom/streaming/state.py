"""Streams that keep state and account for what they leave out: warnings with timers, tallies, audits against static tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sparkloom.sources import stores

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tally(StreamingQueryListener):
    """What a query reports of its batches: observed counts, rows behind the watermark, rows of state. A batch that is run again replaces its report."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended, self._run = name, {}, threading.Event(), None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            observed = p.observedMetrics.get(self.name)
            counts = observed.asDict() if observed else self.batches.get(p.batchId, {}).get("counts", {})
            state = sum(o.numRowsTotal for o in p.stateOperators)
            late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            before = self.batches.get(p.batchId, {})
            self.batches[p.batchId] = {"counts": counts, "state": state, "late": max(late, before.get("late", 0))}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run:
            self.ended.set()

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for batch in self.batches.values():
            for k, v in batch["counts"].items():
                out[k] = out.get(k, 0) + v
        return out

    def late(self) -> int:
        return sum(b["late"] for b in self.batches.values())

    def most_state(self) -> int:
        return max((b["state"] for b in self.batches.values()), default=0)


def run_tallied(stream: DataFrame, name: str, watch=lambda rows, metric: rows) -> tuple[DataFrame, Tally]:
    """Run to the end of the input into Parquet; the rows, and the query's tally. `watch` may observe rows under the name it is given, before any are left out."""
    spark = stream.sparkSession
    query_name = f"{name}-{uuid.uuid4().hex}"
    tally, watched = Tally(query_name), watch(stream, query_name)
    out, state = stores.new_path(spark, f"{name}-out"), stores.new_path(spark, f"{name}-state")
    sink = watched.writeStream.queryName(query_name).format("parquet").option("path", out).option("checkpointLocation", state)
    # states with timers need this store; a query keeps the one it starts with, others of the session keep theirs
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    spark.streams.addListener(tally)
    try:
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        if not tally.ended.wait(60):
            raise RuntimeError(f"no report of the end of {query_name}")
    finally:
        spark.streams.removeListener(tally)
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(watched.schema).parquet(out), tally


def skips(stream: DataFrame, name: str, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason to leave them out, (reason, n) with `kept`). A row counts under the first reason that holds; a condition that is null does not hold."""
    why = F.lit("kept")
    for reason, holds in reversed(reasons.items()):
        why = F.when(holds, reason).otherwise(why)
    names = [*reasons, "kept"]

    def watch(rows: DataFrame, metric: str) -> DataFrame:
        counted = rows.withColumn("loom_why", why).observe(metric, *(F.count_if(F.col("loom_why") == r).alias(r) for r in names))
        return counted.where("loom_why = 'kept'").drop("loom_why")

    kept, tally = run_tallied(stream, name, watch)
    counts = tally.counts()
    return kept, stream.sparkSession.createDataFrame([(r, counts.get(r, 0)) for r in names], "reason string, n bigint")


class _Quiet(StatefulProcessor):
    """Holds the time of a key's last warning, and forgets it by a timer once the quiet time is over."""

    def __init__(self, keys: list[str], when: str, quiet_ms: int):
        self.keys, self.when, self.quiet = keys, when, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([r[self.when] for r in rows], ignore_index=True).sort_values()
        ms = (times.astype("datetime64[us]").astype("int64") // 1000).to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        warned, first = [], last
        for i, at in enumerate(ms.tolist()):
            if last is None or at >= last + self.quiet:
                warned.append(i)
                last = at
        if last != first:
            if first is not None:
                self.handle.deleteTimer(first + self.quiet)
            self.last.update((last,))
            self.handle.registerTimer(last + self.quiet)
        if warned:
            yield pd.DataFrame({**{k: [v] * len(warned) for k, v in zip(self.keys, key)}, self.when: times.iloc[warned].to_list()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def warn_again(events: DataFrame, keys: list[str], when: str, quiet_ms: int, delay: str) -> DataFrame:
    """(keys, when): events that warn. After a warning a key stays quiet for `quiet_ms`; whole milliseconds count.

    Keyed state holds one time a key, and an event-time timer drops it when the quiet time has passed the watermark, so state is bounded by the keys that
    warned lately, not by the feed. Rows of a batch are taken in the order of time; rows behind the watermark are left out by Spark and counted
    in its progress (`Tally.late`). A row without time or key is left out here. Run it by `run_tallied`, which sets the state store it needs.
    """
    known = events.dropna(subset=[*keys, when]).select(*keys, F.col(when).cast("timestamp").alias(when)).withWatermark(when, delay)
    schema = T.StructType([known.schema[c] for c in (*keys, when)])
    return known.groupBy(*keys).transformWithStateInPandas(_Quiet(keys, when, quiet_ms), schema, "append", "eventTime")


def audited(changed: DataFrame, blocks: DataFrame, key: str, name: str) -> DataFrame:
    """The blocks (static, with `a` and `b`) that a change touches, with whether each side was touched.

    A micro-batch of changed keys is joined with the blocks, and what it convicts is written; a batch that is run again replaces what it wrote. Repeats of a key and
    null keys convict nothing more.
    """
    spark = changed.sparkSession
    out, state = stores.new_path(spark, f"{name}-out"), stores.new_path(spark, f"{name}-state")

    def convict(batch: DataFrame, number: int) -> None:
        keys = batch.select(F.col(key).alias("k")).dropna().distinct()
        a, b = keys.select(F.col("k").alias("a"), F.lit(True).alias("a_touched")), keys.select(F.col("k").alias("b"), F.lit(True).alias("b_touched"))
        hit = blocks.join(a, "a", "left").join(b, "b", "left").where("a_touched or b_touched")
        hit.select(*blocks.columns, "a_touched", "b_touched").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = changed.writeStream.foreachBatch(convict).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = T.StructType([*blocks.schema.fields, *(T.StructField(c, T.BooleanType()) for c in ("a_touched", "b_touched")), T.StructField("batch", T.IntegerType())])
    found = spark.read.schema(schema).parquet(out)
    return found.groupBy(*blocks.columns).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("a_touched", "b_touched")))
