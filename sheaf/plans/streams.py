"""Queries: operators on the events table read as a stream; all that is there is processed, then the result returned."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from sheaf.plans.registry import query, table
from sheaf.runtime import scratch
from sheaf.script import Script
from sheaf.sources.sinks import joined
from sheaf.streaming import streams


def _events(spark, sf_dir):
    return streams.events_stream(spark, f"{sf_dir}/events.parquet*")


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("select event_type, count(*) as n from events group by event_type")
def stream_histogram(spark, sf_dir):
    return streams.finished(streams.histogram(_events(spark, sf_dir), "event_type"), _name("histogram"))


@query(f"select {_TS.format('time_bucket(interval 1 hour, ts)')} as at, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, sf_dir):
    out = streams.finished(streams.tumbling(_events(spark, sf_dir), "ts", "1 hour", "10 minutes", "event_type", value=F.col("value")), _name("tumbling"))
    return out.select(_text("window.start").alias("at"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"select {_TS.format('w')} as at, count(*) as n from (select time_bucket(interval 30 minute, ts) - to_minutes(30 * k) as w from events, range(2) t(k)) group by all")
def stream_sliding(spark, sf_dir):
    out = streams.finished(streams.sliding(_events(spark, sf_dir), "ts", "1 hour", "30 minutes", "10 minutes"), _name("sliding"))
    return out.select(_text("window.start").alias("at"), "n")


@query("""with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute then 1 else 0 end as cut from events),
s as (select *, sum(cut) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, cast(count(*) as bigint) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as at from s group by user_id, k""")
def stream_session(spark, sf_dir):
    out = streams.finished(streams.sessions(_events(spark, sf_dir), "ts", "30 minutes", "10 minutes", "user_id"), _name("session"))
    return out.select("user_id", "n", _text("session_window.start").alias("at"))


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, sf_dir):
    df = _events(spark, sf_dir)
    return streams.finished(streams.first_seen(df, "ts", "3650 days", "user_id", "event_type").select("user_id", "event_type"), _name("dedup"), "append")


@query("""with s as (select *, last_value(case when event_type = 'error' then 0 when event_type = 'signup' then 1 end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as st from events)
select user_id, event_id from s where event_type = 'signup' or event_type = 'error' or st = 1""")
def stream_range_state(spark, sf_dir):
    kind = F.col("event_type")
    hits = streams.range_hits(_events(spark, sf_dir), "user_id", "event_id", kind == "signup", kind == "error")
    return streams.finished(hits, _name("ranges"), "append")


@query("select event_id || ' ' || upper(event_type) as line from events where user_id % 2 = 0")
def stream_stateless(spark, sf_dir):
    """A script over records that arrive."""
    events = _events(spark, sf_dir).select(joined(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("line"))
    return streams.finished(Script("$2 % 2 == 0 { print $1, toupper($3) }").run(events), _name("stateless"), "append")


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as at, count(*) as n from events where user_id % 2 = 0 group by all")
def stream_late(spark, sf_dir):
    """Records behind the watermark are left out, windows are written when it has passed them.

    Batches: events of even users, a record ten years on, another, events of odd
    users. The watermark that a batch sets closes windows in the next one and
    shuts out late records from the one after that.
    """
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    path = f"{scratch(spark).rstrip('/')}/sheaf-files/late-{uuid.uuid4().hex}"
    even = F.col("user_id") % 2 == 0
    end = events.agg((F.max("ts") + F.expr("interval 10 years")).alias("ts")).withColumn("user_id", F.lit(0).cast(events.schema["user_id"].dataType))
    for batch in (events.where(even), end, end, events.where(~even)):
        batch.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.finished(streams.tumbling(stream, "ts", "1 hour", "10 minutes", value=F.col("user_id")), _name("late"), "append")
    return out.select(_text("window.start").alias("at"), "n")
