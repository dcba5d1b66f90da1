"""Queries run as streams over the feed's files; batch SQL over the same table gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.graph import settle
from sparkloom.plans.registry import query
from sparkloom.plans.texts import _BETWEEN, _PICKED, clone_blocks
from sparkloom.sources.tables import table
from sparkloom.streaming import feeds, state

def _feed(spark, d):
    return feeds.stream_of(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


@query(
    """select time_bucket(interval 1 hour, ts) as start, event_type, cast(count(*) as bigint) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by all"""
)
def stream_tumbling(spark, d):
    """Hourly windows by type: each batch gives the windows that it changed. The watermark delay spans the table, so no row is late."""
    w = feeds.windowed(_feed(spark, d), "ts", feeds.whole_delay(table(spark, d, "events"), "ts"), "1 hour", ["event_type"])
    return feeds.upserted(w, "tumbling", ["start", "event_type"])


@query(
    """with s as (select ts, unnest([0, 15, 30, 45]) as back from events), w as (select time_bucket(interval 15 minutes, ts) - to_minutes(back) as start from s)
select start, cast(count(*) as bigint) as n from w group by start"""
)
def stream_sliding(spark, d):
    """Hourly windows every quarter, in the same way."""
    w = feeds.windowed(_feed(spark, d), "ts", feeds.whole_delay(table(spark, d, "events"), "ts"), "1 hour", [], "15 minutes")
    return feeds.upserted(w, "sliding", ["start"]).select("start", "n")


@query(
    """with g as (select user_id, ts, event_id, case when ts <= lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hours then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 2 hours as stop, cast(count(*) as bigint) as n from s group by user_id, k"""
)
def stream_sessions(spark, d):
    """Sessions of a user that more than two quiet hours end: an event two hours after the last one, to the second, still belongs to it."""
    s = _feed(spark, d).groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return feeds.run_to_end(s, "sessions", "complete").select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("select user_id, event_type, cast(count(*) > 0 as int) as warned from events where event_type = 'error' group by all")
def stream_warn_once(spark, d):
    """One warning for each user and kind: keyed state drops the rest. The delay spans the table, so no row is late."""
    e = _feed(spark, d).where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    once = feeds.warn_once(e, ["user_id", "event_type"], "ts", feeds.whole_delay(table(spark, d, "events"), "ts")).select("user_id", "event_type", F.lit(1).alias("warned"))
    return feeds.run_to_end(once, "warn-once")


@query(
    """with base as (select user_id, count(*) as seen from events where event_type = 'signup' group by 1)
select event_id, case when e.event_type = 'error' and coalesce(seen, 0) > 10 then 'block' when e.event_type = 'error' then 'warn' when value > 50 then 'note' else 'pass' end as tier
from events e left join base using (user_id)"""
)
def stream_gate(spark, d):
    """Stream against static: each event is judged by an index table, and the strongest tier wins."""
    base = table(spark, d, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"))
    e = _feed(spark, d).join(base, "user_id", "left")
    err = F.col("event_type") == "error"
    tier = F.when(err & (F.coalesce("seen", F.lit(0)) > 10), "block").when(err, "warn").when(F.col("value") > 50, "note").otherwise("pass")
    return feeds.run_to_end(e.select("event_id", tier.alias("tier")), "gate")


@query("select doc_id, md5(coalesce(text, '')) as h, lang from documents")
def stream_refresh(spark, d):
    """Incremental refresh: a batch overwrites the buckets of changed content alone; replayed, it writes nothing."""
    docs = feeds.stream_of(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), "lang")
    return feeds.refreshed(docs, "refresh", "doc_id", "h").select("doc_id", "h", "lang")


@query(
    """select a.event_id as click, b.event_id as purchase from events a join events b
    on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 30 minutes"""
)
def stream_stream_join(spark, d):
    """Purchases within half an hour of a click of the user: both sides streams. The watermark delay spans the table: no row is late and no state that can
    still match is dropped, in any order of files; state is bounded by the table."""
    delay = feeds.whole_delay(table(spark, d, "events"), "ts")
    e = _feed(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.where("event_type = 'click'").select(F.col("user_id").alias("ua"), F.col("ts").alias("ta"), F.col("event_id").alias("click")).withWatermark("ta", delay)
    b = e.where("event_type = 'purchase'").select(F.col("user_id").alias("ub"), F.col("ts").alias("tb"), F.col("event_id").alias("purchase")).withWatermark("tb", delay)
    j = a.join(b, F.expr("ua = ub and tb >= ta and tb <= ta + interval 30 minutes"))
    return feeds.run_to_end(j.select("click", "purchase"), "pairs")


_QUIET_HOURS = 12


@query(
    f"""with recursive e as (select user_id, event_type, ts from events where event_type in ('error', 'signup')),
w as (select user_id, event_type, min(ts) as ts from e group by user_id, event_type
    union all
    select w.user_id, w.event_type, min(e.ts) as ts from w join e on e.user_id = w.user_id and e.event_type = w.event_type
        and epoch_ms(e.ts) >= epoch_ms(w.ts) + {_QUIET_HOURS} * 3600000 group by w.user_id, w.event_type)
select user_id, event_type, ts from w"""
)
def stream_warn_again(spark, d):
    """Warnings that repeat only after half a quiet day: keyed state of one time, dropped by an event-time timer. An hour of delay; what comes later is counted."""
    e = _feed(spark, d).where("event_type in ('error', 'signup')")
    warned, _ = state.run_tallied(state.warn_again(e, ["user_id", "event_type"], "ts", _QUIET_HOURS * 3_600_000, "1 hour"), "warn-again")
    return warned.select("user_id", "event_type", F.col("ts").cast(table(spark, d, "events").schema["ts"].dataType).alias("ts"))


@query(
    """with w as (select case when user_id is null then 'no user' when value is null then 'no value' when coalesce(try_cast(json_extract_string(props, '$.k') as integer), 0) < 10 then 'weak props'
    when value > 100 then 'outlier' else 'kept' end as reason from events)
select r.reason, cast(count(w.reason) as bigint) as n from (values ('no user'), ('no value'), ('weak props'), ('outlier'), ('kept')) r(reason) left join w using (reason) group by r.reason"""
)
def stream_skips(spark, d):
    """Rows that the feed leaves out, by the first reason that holds: observed as they pass, summed over batches by a listener."""
    props = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    reasons = {"no user": F.col("user_id").isNull(), "no value": F.col("value").isNull(), "weak props": props < 10, "outlier": F.col("value") > 100}
    return state.skips(_feed(spark, d), "skips", reasons)[1]


@query(
    f"""with {_BETWEEN}, blocks as ({_PICKED}), touched as (select doc_id from documents where lang <> 'en')
select blocks.*, a in (from touched) as a_touched, b in (from touched) as b_touched from blocks where a in (from touched) or b in (from touched)"""
)
def stream_audit(spark, d):
    """Clone blocks that a feed of changed documents (here those in other languages than English) touches: micro-batches against a static table."""
    changed = feeds.stream_of(spark, d, "documents").where("lang <> 'en'")
    return state.audited(changed, settle(clone_blocks(spark, d)), "doc_id", "audit")
