"""Streaming queries by name. Those that emit everything are held against the batch SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SQL_SAMPLES, files, samples, table
from ..operators import distribution
from ..sources import inventories
from ..streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "t_windowed_metrics",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS samples, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2)
  SELECT epoch(start)::BIGINT AS start, event_type, samples, mean, errors FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
)
def _(spark, d):
    out = streams.finished(streams.windowed(streams.events_stream(spark, d), "event_type"), "windows")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "samples", F.round("mean", 6).alias("mean"), "errors")


@query("t_interval_join", "SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3600 SECONDS WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
def _(spark, d):
    both = streams.events_stream(spark, d), streams.events_stream(spark, d)
    return streams.finished(streams.within(both[0].where("event_type = 'error'"), both[1].where("event_type = 'purchase'"), "user_id", 3600), "join")


@query("t_sessions")
def _(spark, d):
    return streams.finished(streams.sessions(streams.events_stream(spark, d), "user_id"), "sessions")


@query("t_first_within_watermark")
def _(spark, d):
    return streams.finished(streams.first_within_watermark(streams.events_stream(spark, d), ["user_id", "event_type"]).select("event_id", "user_id", "event_type"), "first")


def _as_samples(events):
    return events.select(
        (F.col("user_id") % 12).alias("link"), F.col("event_id").alias("sample_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("bandwidth"),
        ((F.col("event_id") % 37) * 40).cast("double").alias("latency_ms"), F.when(F.col("event_type") == "error", 0.02).otherwise(0.001).alias("loss"), (F.col("event_type") != "error").alias("success"),
    )


@query("t01_congestion_stream")
def _(spark, d):
    return streams.finished(streams.congestion_stream(_as_samples(streams.events_stream(spark, d))), "congestion")


@query("t01_congestion_batch")
def _(spark, d):
    return streams.congestion_batch(_as_samples(table(spark, d, "events")))


@query("t16_failovers", f"""WITH {SQL_SAMPLES}, o AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ts, sample_id) AS i FROM samples), g AS (SELECT *, i - coalesce(max(i) FILTER (success) OVER (PARTITION BY link ORDER BY i), 0) AS run FROM o),
  f AS (SELECT *, lag(run) OVER (PARTITION BY link ORDER BY i) AS before FROM g)
  SELECT link, sample_id, CASE WHEN success THEN 'recovered' ELSE 'failover' END AS event, CAST(CASE WHEN success THEN 0 ELSE 3 END AS INTEGER) AS failures FROM f WHERE run = 3 OR success AND before >= 3""")
def _(spark, d):
    return streams.finished(streams.failover_stream(_as_samples(streams.events_stream(spark, d))), "failovers")


@query("t15_sticky_stream")
def _(spark, d):
    events = streams.events_stream(spark, d)
    requests = events.select(F.col("user_id").alias("key"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("NATION_"), (F.col("event_id") % 25).cast("string")).alias("region"))
    return streams.finished(streams.sticky_stream(requests, 86400.0), "sticky").select("key", "id", "region")


@query("t18_running_counters", f"WITH {SQL_SAMPLES} SELECT sample_id, count(*) OVER w AS done, count(*) FILTER (NOT success) OVER w AS errors FROM samples WINDOW w AS (PARTITION BY link ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("link").orderBy("ts", "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    return samples(spark, d).select("sample_id", F.count("*").over(w).alias("done"), F.sum((~F.col("success")).cast("long")).over(w).alias("errors"))


@query("s06_archive_tocs", "SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS destination FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).alias("destination"), F.encode("text", "UTF-8").alias("content"))
    packed = docs.withColumn("suitcase_index", F.col("doc_id") % 1000 + 1)
    built = inventories.build_archives(packed, "tar.gz")
    return inventories.archive_tocs(built, "suitcase_index").select(F.explode("toc").alias("destination"))


@query("k03_hash_lines", "SELECT concat(md5(text), chr(9), doc_id) AS value FROM documents")
def _(spark, d):
    return inventories.hash_lines(table(spark, d, "documents").select(F.md5("text").alias("hash"), F.col("doc_id").cast("string").alias("filename")))


@query("k02_inventory_json")
def _(spark, d):
    return inventories.inventory_json(distribution.by_hash(files(spark, d), 8, "destination"))
