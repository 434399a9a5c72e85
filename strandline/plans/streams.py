"""Queries that run streams over the events table until its files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.cohort import query
from strandline.streaming import ingest as s
from strandline.streaming import keyed as k

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _source(t):
    """The events as a folder of files, written by Spark."""
    folder = s.scratch(t.spark, "events")
    t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").write.parquet(folder)
    return folder


@query("st01_incremental_ingest", "SELECT event_type, 2 * count(*) - count(*) FILTER (WHERE user_id % 2 = 0) AS n FROM events GROUP BY 1")
def st01(t):
    source, target, mark = _source(t), s.scratch(t.spark, "ingested"), s.scratch(t.spark, "mark")
    s.ingest_new_files(t.spark, source, _EVENTS, target, mark)
    # more files, of odd users, arrive; those read before aren't read again
    t.spark.read.parquet(source).where("user_id % 2 = 1").write.mode("append").parquet(source)
    s.ingest_new_files(t.spark, source, _EVENTS, target, mark)
    return t.spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st02_stream_upsert", "SELECT event_id, event_type, value FROM events")
def st02(t):
    source, target, mark = _source(t), s.scratch(t.spark, "upserted"), s.scratch(t.spark, "mark")
    s.stream_upsert(t.spark, source, _EVENTS, "event_id", target, mark, "ts")
    t.spark.read.parquet(source).where("user_id % 2 = 1").write.mode("append").parquet(source)  # the same rows once more
    s.stream_upsert(t.spark, source, _EVENTS, "event_id", target, mark, "ts")
    return s.latest_version(t.spark, target, mark).select("event_id", "event_type", "value")


@query("st03_change_events", "SELECT user_id, event_id, b AS from_state, event_type AS to_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b <> event_type")
def st03(t):
    target, mark = s.scratch(t.spark, "changes"), s.scratch(t.spark, "mark")
    stream = t.spark.readStream.schema(_EVENTS).parquet(_source(t))
    s.run_to_folder(s.change_events(stream, "user_id", ["ts", "event_id"], "event_type"), target, mark)
    return t.spark.read.parquet(target).select("user_id", "event_id", "from_state", "to_state")


@query("st03_windowed_counts", "SELECT event_type, count(*)::bigint AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1")
def st03b(t):
    target, mark = s.scratch(t.spark, "windows"), s.scratch(t.spark, "mark")
    stream = t.spark.readStream.schema(_EVENTS).parquet(_source(t))
    s.run_to_folder(s.windowed_counts(stream, "ts", "event_type", "1 day", "0 seconds"), target, mark)
    return t.spark.read.parquet(target).groupBy("event_type").agg(F.sum("n").alias("n"))


def _twice(t):
    """The events of odd users in a first folder of files; all events, changed where the value is over 50, in a second."""
    from strandline.operators.components import cut_lineage

    rows = cut_lineage(t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"))
    later = rows.withColumns({"event_type": F.expr("CASE WHEN value > 50 THEN 'changed' ELSE event_type END"), "ts": F.expr("ts + INTERVAL 1 DAY")})
    return rows.where("user_id % 2 = 1"), later


@query("st02_upsert_by_buckets", "SELECT event_id, CASE WHEN value > 50 THEN 'changed' ELSE event_type END AS event_type, value FROM events")
def st02_buckets(t):
    source, target, mark = (s.scratch(t.spark, name) for name in ("arriving", "kept", "mark"))
    first, later = _twice(t)
    for rows in (first, later, first):  # the last are old rows once more
        rows.write.mode("append").parquet(source)
        k.upsert_stream(t.spark.readStream.schema(_EVENTS).parquet(source), "event_id", target, mark, "ts")
    return k.upserted(t.spark, target).select("event_id", "event_type", "value")


@query("st03_expiring_changes", "SELECT user_id, event_id, b AS from_state, event_type AS to_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b <> event_type")
def st03_expiring(t):
    target, mark = s.scratch(t.spark, "changes"), s.scratch(t.spark, "mark")
    stream = t.spark.readStream.schema(_EVENTS).parquet(_source(t))
    s.run_to_folder(k.expiring_changes(stream, "user_id", "ts", ["event_id"], "event_type", keep="36500 days"), target, mark)
    return t.spark.read.parquet(target).select("user_id", "event_id", "from_state", "to_state")
