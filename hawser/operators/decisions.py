"""Decisions over current state: recommendations, selections, session parameters, status rows, rules as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed, ladder

# Fixed values by reason: (added streams, added MB, window, congestion window, slow start, algorithm); no streams or MB
# added for network_degradation, which sets 2 and 10.
FLOW = {
    "underutilization": (2, 10, 128, 20, 64, "bbr"),
    "congestion": (-1, -5, 32, 5, 16, "cubic"),
    "poor_efficiency": (0, 0, 64, 10, 32, "bbr"),
    "network_degradation": (0, 0, 16, 3, 8, "cubic"),
}


def recommendations(rows: DataFrame) -> DataFrame:
    """`rows` (reason, available, concurrency, chunk_mb) with what to change to; no row for no reason."""
    reason = F.col("reason")
    rows = rows.where(reason.isNotNull())
    pick = lambda i: ladder([(reason == r, v[i]) for r, v in FLOW.items()], FLOW["poor_efficiency"][i])
    degraded = reason == "network_degradation"
    streams = F.when(degraded, 2).otherwise(F.greatest(F.least(F.col("concurrency") + pick(0), F.lit(8)), F.lit(1)))
    chunk = F.when(degraded, 10).otherwise(F.greatest(F.least(F.col("chunk_mb") + pick(1), F.lit(100)), F.lit(5)))
    codec = ladder([((reason == "underutilization") & (F.col("available") > 50), "zstd-fast"), (reason.isin("congestion", "network_degradation"), "zstd-high")], "zstd")
    return rows.withColumns({
        "to_concurrency": streams.cast("long"), "to_chunk_mb": chunk.cast("long"), "to_codec": codec, "window": pick(2).cast("long"),
        "congestion_window": pick(3).cast("long"), "slow_start": pick(4).cast("long"), "algorithm": pick(5),
    })


def session_parameters(rows: DataFrame) -> DataFrame:
    """`rows` (reason, bandwidth, latency_ms, congestion, remaining_mb, concurrency, chunk_mb, codec, retries) after adapting.

    Poor performance: a stream more on a free network, a chunk of the bandwidth-delay product (no larger than what
    remains), a faster codec over 50 MB/s. Declining performance: a stream less, 5 MB less, one retry more.
    """
    c, reason = F.col, F.col("reason")
    product = c("bandwidth") * (c("latency_ms") / 1000.0)
    product = F.when((c("remaining_mb") > 0) & (c("remaining_mb") < product.cast("long")), c("remaining_mb").cast("double")).otherwise(product)
    best = F.greatest(F.least((product * (1.0 - c("congestion") * 0.3)).cast("long"), F.lit(100)), F.lit(5))
    poor, declining = reason == "poor_performance", reason == "declining_performance"
    return rows.withColumns({
        "to_concurrency": ladder([(poor & (c("congestion") < 0.3) & (c("concurrency") < 8), c("concurrency") + 1), (declining, F.greatest(c("concurrency") - 1, F.lit(1)))], c("concurrency")).cast("long"),
        "to_chunk_mb": ladder([(poor, best), (declining, F.greatest(c("chunk_mb") - 5, F.lit(5)))], c("chunk_mb")).cast("long"),
        "to_codec": F.when(poor & (c("bandwidth") > 50), "zstd-fast").otherwise(c("codec")),
        "to_retries": F.when(declining, F.least(c("retries") + 1, F.lit(5))).otherwise(c("retries")).cast("long"),
    })


def chosen_prefix(uploads: DataFrame, best: DataFrame, confidence: float, trend: str) -> DataFrame:
    """Prefix of each upload (size, deadline_s): with over 0.7 confidence, large uploads follow a rising prefix and urgent
    ones the least latency; others the best score. `best` is one row (best_score, lowest_latency, rising).
    """
    joined = uploads.join(F.broadcast(best))
    learned = F.lit(confidence > 0.7)
    rules = [(learned & F.lit(trend == "increasing") & (F.col("size") > 1 << 30) & F.col("rising").isNotNull(), F.col("rising")), (learned & (F.col("deadline_s") < 3600) & F.col("lowest_latency").isNotNull(), F.col("lowest_latency"))]
    return joined.withColumn("prefix", ladder(rules, F.col("best_score"))).drop(*best.columns)


def status_rows(stats: DataFrame) -> DataFrame:
    """Status rows of transfer statistics (finished, success, percent, bytes, total): percent and bytes are halved, as
    the counters run twice; a complete transfer has half of its total.
    """
    c = F.col
    complete = c("finished") & c("success")
    half = lambda name: F.floor(c(name) / 2).cast("long")
    return stats.withColumns({
        "status": ladder([(~c("finished"), "in_progress"), (complete, "complete")], "failed"), "percent_done": half("percent"),
        "transferred": F.when(complete, half("total")).otherwise(half("bytes")), "size_bytes": F.when(complete, half("total")).otherwise(c("total")),
    })


def object_metadata(archives: DataFrame, custom: str = "metadata") -> DataFrame:
    """`archives` with metadata as key=value text in order of keys: the custom map, over it the fixed keys."""
    fixed = F.map_filter(
        F.create_map(
            F.lit("access-pattern"), F.nullif("pattern", F.lit("")), F.lit("original-size"), F.col("size").cast("string"),
            F.lit("retention-days"), F.when(F.col("retention_days") > 0, F.col("retention_days").cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    own = F.map_filter(F.col(custom), lambda k, v: ~F.array_contains(F.map_keys(fixed), k))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat(own, fixed))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return archives.withColumn("metadata_text", text)


def rule_document(prefix: Column, tags: Column, transitions: Column, expiration: Column) -> Column:
    """A lifecycle rule as JSON; its filter is a prefix, a single tag, both under And, or none."""
    entries = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.struct(e["key"].alias("Key"), e["value"].alias("Value")))
    n, has = F.size(entries), F.coalesce(prefix, F.lit("")) != ""
    both = (n > 1) | (has & (n > 0))
    single = F.when(~both & (n == 1) & ~has, entries[0])
    shape = F.struct(
        F.when(both, F.struct(F.when(has, prefix).alias("Prefix"), entries.alias("Tags"))).alias("And"), F.when(has & (n == 0), prefix).alias("Prefix"), single.alias("Tag"),
    )
    steps = F.transform(transitions, lambda t: F.struct(t["days"].alias("Days"), t["class"].alias("StorageClass")))
    return F.to_json(F.struct(F.when(expiration > 0, F.struct(expiration.alias("Days"))).alias("Expiration"), F.when(has | (n > 0), shape).alias("Filter"), F.when(F.size(steps) > 0, steps).alias("Transitions")))


def in_progress(regions: DataFrame, operations: DataFrame) -> DataFrame:
    """Regions that a running failover leaves (operations: from_region, status)."""
    running = operations.where("status = 'in_progress'").select(F.col("from_region").alias("name"))
    return regions.join(running, "name", "left_semi")


def best_of(candidates: DataFrame, key: str, score: Column, order: str) -> DataFrame:
    """Per key the candidate with the best score, first by `order` on ties."""
    fields = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(score.alias("s"), (-F.col(order)).alias("o"))).alias("b")).select(key, "b.*")


def latest_state(updates: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Per key the newest update."""
    fields = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(ts, tie)).alias("b")).select(key, "b.*")


def overhead_percent(n: Column) -> Column:
    return F.least(n * 1.0, F.lit(10.0))


def reliability_key(size: Column, compression: Column, bandwidth: Column, latency: Column, congestion: Column) -> Column:
    """Text that stands for a boundary and a condition with its numbers rounded."""
    return F.format_string("boundary_%d_%d_network_%s_%s_%s", size.cast("long"), (compression * 100).cast("int"), fixed(bandwidth, 1), fixed(latency, 1), fixed(congestion, 3))


def failover_routes(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """Region that takes each request (preferred, fails: names that reject it): the preferred one, else the healthy one
    with the least priority that doesn't reject it; null if none. Regions are a few rows, taken along as one list.
    """
    healthy = regions.where("status = 'healthy'").agg(F.sort_array(F.collect_list(F.struct("priority", "name"))).alias("_options"))
    out = requests.join(F.broadcast(healthy))
    takes = lambda name: ~F.array_contains(F.col("fails"), name)
    liked = F.exists("_options", lambda o: o["name"] == F.col("preferred")) & takes(F.col("preferred"))
    left = F.filter("_options", lambda o: takes(o["name"]))
    return out.withColumn("region", F.when(liked, F.col("preferred")).otherwise(F.get(left, 0)["name"])).drop("_options")
