"""Aggregates, trends and decisions over transfer and network samples.

Bounded histories are windows of the last rows of a key in order of time, ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import bounded, ladder, truncated


def last(n: int, key: str = "link", ts: str = "ts", tie: str = "sample_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts, tie).rowsBetween(-(n - 1), Window.currentRow)


def moving_conditions(samples: DataFrame) -> DataFrame:
    """Per sample, from the last ten of its link: mean bandwidth and latency, jitter, loss, congestion and reliability scores."""
    w = last(10)
    bandwidth, latency = F.avg("bandwidth").over(w), F.avg("latency_ms").over(w)
    out = samples.select("sample_id", "link", bandwidth.alias("est_bandwidth"), latency.alias("est_latency"), F.when(F.count("*").over(w) < 2, 2.0).otherwise(F.stddev_pop("latency_ms").over(w)).alias("jitter"))
    b, lat, loss, congestion = (F.col(c) for c in ("est_bandwidth", "est_latency", "est_loss", "est_congestion"))
    out = out.withColumn("est_loss", ladder([(b < 10, 0.05), (b < 50, 0.01)], 0.001))
    score = ladder([(b < 20, 0.4), (b < 50, 0.2)], 0.0) + ladder([(lat > 100, 0.3), (lat > 50, 0.1)], 0.0) + ladder([(loss > 0.01, 0.3), (loss > 0.005, 0.1)], 0.0)
    out = out.withColumn("est_congestion", F.least(score, F.lit(1.0)))
    return out.withColumn("est_reliability", F.greatest(1.0 - congestion * 0.3 - loss * 10.0, F.lit(0.1)))


def mean_step(value: str, w: WindowSpec) -> Column:
    """Mean difference of neighbours in the window, which telescopes to last less first; 0 for one row."""
    n = F.count("*").over(w)
    return F.when(n < 2, 0.0).otherwise(F.try_divide(F.col(value) - F.first(value).over(w), n - 1))


def forecasts(samples: DataFrame, value: str, seconds: float = 60.0) -> DataFrame:
    """Linear extrapolation of `value` from the last five, with a confidence from the spread of the last ten."""
    five, ten = last(5), last(10)
    trend, n, mean, spread = mean_step(value, five), F.count("*").over(ten), F.avg(value).over(ten), F.stddev_pop(value).over(ten)
    out = samples.select("sample_id", "link", F.col(value), trend.alias("trend"), n.alias("_n"), mean.alias("_mean"), spread.alias("_spread"))
    base = 1.0 - F.least(F.try_divide(F.col("_spread"), F.col("_mean")), F.lit(1.0)) + F.when(F.abs("trend") < F.col("_mean") * 0.1, 0.1).otherwise(0.0)
    confidence = F.when((F.col("_n") < 3) | (F.col("_mean") == 0), 0.5).otherwise(bounded(base, 0.1, 0.95))
    predicted = F.when(F.col("_n") < 2, 0.0).otherwise(F.greatest(F.col(value) + F.col("trend") * seconds / 60.0, F.lit(0.0)))
    return out.select("sample_id", "link", "trend", predicted.alias("predicted"), confidence.alias("confidence"))


def _slope_over_mean(value: Column, w: WindowSpec, position: Column) -> Column:
    slope = F.regr_slope(value, position).over(w)
    mean = F.avg(value).over(w)
    return F.coalesce(F.when(mean == 0, slope).otherwise(F.try_divide(slope, mean)), F.lit(0.0))


def network_trend(samples: DataFrame, corrected: bool = False) -> DataFrame:
    """Trend of each sample's last ten: improving, degrading, volatile, stable; unknown for fewer than three.

    Latency and congestion enter inverted and are divided by their own (negative) mean, which turns the sign back, so
    that rising latency counts as improving; corrected=True divides by the absolute mean instead.
    """
    w, order = last(10), Window.partitionBy("link").orderBy("ts", "sample_id")
    rows = samples.withColumn("_x", F.row_number().over(order).cast("double"))
    sign = -1.0 if corrected else 1.0
    parts = [_slope_over_mean(F.col("bandwidth"), w, F.col("_x")), sign * _slope_over_mean(F.col("latency_ms"), w, F.col("_x")), sign * _slope_over_mean(F.col("congestion"), w, F.col("_x"))]
    rows = rows.select("sample_id", "link", F.count("*").over(w).alias("_n"), (sum(parts[1:], parts[0]) / 3.0).alias("trend"), F.coalesce(F.try_divide(F.stddev_pop("bandwidth").over(w), F.avg("bandwidth").over(w)), F.lit(0.0)).alias("volatility"))
    label = ladder([(F.col("_n") < 3, "unknown"), (F.col("trend") > 0.1, "improving"), (F.col("trend") < -0.1, "degrading"), (F.col("volatility") > 0.5, "volatile")], "stable")
    return rows.select("sample_id", "link", "trend", "volatility", label.alias("label"))


def recent_against_history(samples: DataFrame, recent: int = 3, history: int = 20, least: int = 5) -> DataFrame:
    """Per link at its end: means of the last few and of the history, and their relative difference."""
    back = Window.partitionBy("link").orderBy(F.desc("ts"), F.desc("sample_id"))
    kept = samples.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= history)
    out = kept.groupBy("link").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_back") <= recent, F.col("bandwidth"))).alias("recent"), F.avg("bandwidth").alias("overall"))
    return out.where(F.col("n") >= least).withColumn("change", F.try_divide(F.col("recent") - F.col("overall"), F.col("overall")))


def overall_trend(per_link: DataFrame) -> DataFrame:
    """One row: increasing, decreasing or stable over all links, and the link that rose most."""
    diff = F.try_divide(F.avg("recent") - F.avg("overall"), F.avg("overall"))
    rising = F.max_by(F.when(F.col("change") > 0, F.col("link")), F.struct(F.when(F.col("change") > 0, F.col("change")), -F.col("link")))
    out = per_link.agg(diff.alias("change"), rising.alias("best_link"))
    return out.withColumn("trend", ladder([(F.col("change") > 0.1, "increasing"), (F.col("change") < -0.1, "decreasing")], "stable"))


def smoothed(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Per link: exponential mean of bandwidth seeded with the first value, and the peak.

    The mean is a weighted sum, alpha * (1 - alpha)**age and (1 - alpha)**age for the first, so it adds up partially
    once ages are known.
    """
    back = F.row_number().over(Window.partitionBy("link").orderBy(F.desc("ts"), F.desc("sample_id")))
    rows = samples.select("link", "bandwidth", (back - 1).alias("_age"), F.count("*").over(Window.partitionBy("link")).alias("_n"))
    faded = F.pow(F.lit(1 - alpha), F.col("_age"))
    weight = F.when(F.col("_age") == F.col("_n") - 1, faded).otherwise(alpha * faded)
    return rows.groupBy("link").agg(F.sum(F.col("bandwidth") * weight).alias("smoothed"), F.max("bandwidth").alias("peak"))


def peak_within(samples: DataFrame, interval: str = "INTERVAL '10' SECOND") -> DataFrame:
    """Largest bandwidth of the link in the time before each sample, itself included."""
    peak = F.expr(f"max(bandwidth) OVER (PARTITION BY link ORDER BY ts RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW)")
    return samples.select("sample_id", "link", peak.alias("peak"))


def last_per_key(rows: DataFrame, n: int, key: str = "link", ts: str = "ts", tie: str = "sample_id") -> DataFrame:
    back = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")


def halves_trend(samples: DataFrame) -> DataFrame:
    """Per link: (mean of the later half less that of the earlier) over the earlier; the middle one counts as later."""
    order = Window.partitionBy("link").orderBy("ts", "sample_id")
    rows = samples.select("link", "bandwidth", F.row_number().over(order).alias("_i"), F.count("*").over(Window.partitionBy("link")).alias("_n"))
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy("link").agg(F.avg(F.when(early, F.col("bandwidth"))).alias("early"), F.avg(F.when(~early, F.col("bandwidth"))).alias("late"))
    return out.select("link", F.coalesce(F.try_divide(F.col("late") - F.col("early"), F.col("early")), F.lit(0.0)).alias("trend"))


def failure_runs(samples: DataFrame) -> DataFrame:
    """Per link: checks, failures, failure rate in percent, failures in a row at the end, and whether it counts as failed.

    It does with three failures in a row, with over 75 % failures in more than ten checks, or when its last check failed
    over 15 minutes after the last good one (or none was good). A null ts tells no time, so the last rule is left out.
    """
    order = Window.partitionBy("link").orderBy("ts", "sample_id")
    rows = samples.select("link", "success", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), F.row_number().over(order).alias("_i"))
    good = F.when(F.col("success"), F.col("_i"))
    out = rows.groupBy("link").agg(
        F.count("*").alias("checks"), F.count_if(~F.col("success")).alias("failures"), F.coalesce(F.max(good), F.lit(0)).alias("_last_good"),
        F.max("_at").alias("_now"), F.max(F.when(F.col("success"), F.col("_at"))).alias("_good_at"),
    )
    out = out.withColumn("consecutive", F.col("checks") - F.col("_last_good")).withColumn("failure_rate", F.try_divide(F.col("failures") * 100.0, F.col("checks")))
    prolonged = (F.col("consecutive") > 0) & F.coalesce(F.col("_now") - F.col("_good_at") > 15 * 60 * 1_000_000, F.col("_last_good") == 0)
    failed = (F.col("consecutive") >= 3) | ((F.col("failure_rate") > 75) & (F.col("checks") > 10)) | prolonged
    return out.withColumn("failed", failed).drop("_last_good", "_now", "_good_at")


def change_reasons(samples: DataFrame, target: float = 50.0) -> DataFrame:
    """Why the parameters should be adapted at a sample, against the one before on its link; first reason that holds, or null."""
    order = Window.partitionBy("link").orderBy("ts", "sample_id")
    prev = {c: F.lag(c).over(order) for c in ("bandwidth", "latency_ms", "loss", "congestion")}
    rows = samples.select("*", *(p.alias(f"_p_{c}") for c, p in prev.items()))
    c, p = F.col, lambda n: F.col(f"_p_{n}")
    moved = lambda n: F.try_divide(F.abs(c(n) - p(n)), p(n))
    more = lambda n, up, down: F.when(c(n) > p(n), up).otherwise(down)
    reason = ladder(
        [
            (p("bandwidth").isNull(), "initial_adaptation"),
            (moved("bandwidth") > 0.1, more("bandwidth", "bandwidth_increase", "bandwidth_decrease")),
            (moved("latency_ms") > 0.2, more("latency_ms", "latency_increase", "latency_decrease")),
            (F.abs(c("loss") - p("loss")) > 0.001, more("loss", "packet_loss_increase", "packet_loss_decrease")),
            ((c("congestion") > 0.5) & (p("congestion") <= 0.5), "congestion_detected"),
            ((c("congestion") <= 0.3) & (p("congestion") > 0.3), "congestion_cleared"),
            (c("bandwidth") < target * 0.8, "throughput_below_target"),
            (c("latency_ms") > 75, "latency_above_target"),
            (c("loss") > 0.01, "loss_above_threshold"),
        ],
        F.lit(None).cast("string"),
    )
    return rows.select(*samples.columns, reason.alias("reason"))


def adapted_parameters(rows: DataFrame, chunk_mb: int = 24, concurrency: int = 4, codec: str = "zstd") -> DataFrame:
    """Parameters after adapting from the given ones for each row's `reason`; within 5..100 MB and 1..8 streams."""
    c = F.col
    bdp = truncated(c("bandwidth") * (c("latency_ms") / 1000.0) * (1.0 - c("congestion") * 0.5) * (1.0 - c("loss") * 10.0))
    best_chunk = F.greatest(F.least(bdp, F.lit(100)), F.lit(5))
    streams = truncated(c("bandwidth") / 25.0)
    streams = F.when(c("congestion") > 0.3, truncated(streams * (1.0 - c("congestion")))).otherwise(streams)
    streams = F.when(c("latency_ms") > 100, F.greatest(streams - 1, F.lit(1))).otherwise(streams)
    best_streams = F.greatest(F.least(streams, F.lit(8)), F.lit(1))
    best_codec = ladder([(c("bandwidth") > 100, "zstd-fast"), (c("bandwidth") < 20, "zstd-high"), (c("latency_ms") > 100, "zstd-high")], "zstd")
    of = lambda name: c("reason") == name
    low = F.when(c("bandwidth") < 30, "zstd-high").otherwise("zstd-fast")
    chunk = ladder(
        [(of(r), int(chunk_mb * f)) for r, f in (("bandwidth_increase", 1.2), ("bandwidth_decrease", 0.8), ("latency_increase", 1.3), ("latency_decrease", 0.9), ("congestion_detected", 0.7), ("congestion_cleared", 1.1), ("packet_loss_increase", 0.8))]
        + [(c("reason").isNull(), chunk_mb)], best_chunk,
    )
    plus, minus = min(concurrency + 1, 8), max(concurrency - 1, 1)
    streams_now = ladder(
        [
            (of("bandwidth_increase"), F.when(c("congestion") < 0.3, plus).otherwise(concurrency)), (of("bandwidth_decrease"), minus), (of("latency_increase"), minus),
            (of("latency_decrease"), F.when(c("congestion") < 0.2, plus).otherwise(concurrency)), (of("congestion_detected"), max(concurrency - 2, 1)), (of("congestion_cleared"), plus),
            (of("packet_loss_increase"), minus), (of("throughput_below_target"), F.when(c("congestion") < 0.4, plus).otherwise(concurrency)), (c("reason").isNull(), concurrency),
        ],
        best_streams,
    )
    codec_now = ladder(
        [
            (of("bandwidth_increase"), F.when(c("bandwidth") > 100, "zstd-fast").otherwise(codec)), (of("bandwidth_decrease"), F.when(c("bandwidth") < 20, "zstd-high").otherwise(codec)),
            (of("congestion_detected"), "zstd-high"), (of("congestion_cleared"), "zstd"), (of("throughput_below_target"), low),
            (of("latency_increase") | of("latency_decrease") | of("packet_loss_increase") | c("reason").isNull(), codec),
        ],
        best_codec,
    )
    return rows.select("sample_id", "link", "reason", F.greatest(F.least(chunk, F.lit(100)), F.lit(5)).cast("long").alias("chunk_mb"), streams_now.cast("long").alias("concurrency"), codec_now.alias("codec"))


def predictions(samples: DataFrame, size: int) -> DataFrame:
    """What an upload of `size` bytes (compression score 0.5) would do under each sample's condition."""
    c, mb = F.col, size / (1 << 20)
    reliability = 1.0 - c("loss") * 10.0
    rows = samples.withColumn("_reliability", reliability)
    r = c("_reliability")
    base = F.try_divide(F.lit(mb), c("bandwidth")) * 0.75
    seconds = F.when(c("bandwidth") <= 0, 3600.0).otherwise(base + c("latency_ms") / 1000.0 + c("congestion") * base * 0.5 + (1.0 - r) * base * 0.3 + 2.0)
    throughput = F.greatest(c("bandwidth") * (1.0 + 0.15 - c("congestion") * 0.4 - (1.0 - r) * 0.2), c("bandwidth") * 0.1)
    penalty = 0.1 if size > 100 << 20 else 0.05 if size > 50 << 20 else 0.0
    success = bounded(r - penalty - c("congestion") * 0.2 - F.least(c("latency_ms") / 1000.0, F.lit(0.1)), 0.1, 0.99)
    best = c("bandwidth") * 2 * F.when(r < 0.8, 0.5).otherwise(1.0) * F.when(c("latency_ms") > 100, 1.5).otherwise(1.0) * F.when(c("congestion") > 0.5, 0.7).otherwise(1.0)
    chunk = F.greatest(F.least(truncated(best * (1 << 20)), F.lit(100 << 20)), F.lit(5 << 20))
    wait = F.try_divide(F.lit(mb), c("bandwidth"))
    fit = F.least(ladder([(wait < 10, 0.4), (wait < 30, 0.2)], 0.0) + r * 0.3 + (1.0 - c("congestion")) * 0.2 + F.when(c("latency_ms") < 50, 0.1).otherwise(0.0), F.lit(1.0))
    codec = ladder([(c("bandwidth") < 10, "zstd-max"), (c("bandwidth") > 100, "zstd-fast")], "zstd-fast")
    return rows.select("sample_id", seconds.alias("seconds"), throughput.alias("throughput"), success.alias("success_probability"), chunk.cast("long").alias("chunk_bytes"), fit.alias("suitability"), codec.alias("codec"))


def optimisation_needs(rows: DataFrame) -> DataFrame:
    """`rows` with utilisation, congestion, available and utilised bandwidth: efficiency, health, reason and priority."""
    u, c = F.col("utilisation"), F.col("congestion")
    efficiency = bounded(u - c * 0.5 + F.when(u.between(0.7, 0.8), 0.1).otherwise(0.0), 0.0, 1.0)
    rows = rows.withColumn("efficiency", efficiency)
    e = F.col("efficiency")
    score = (1.0 - c * 0.6) * e * F.when((u < 0.3) | (u > 0.9), 0.8).otherwise(1.0)
    rows = rows.withColumn("health", ladder([(score >= 0.8, "excellent"), (score >= 0.6, "good"), (score >= 0.4, "fair"), (score >= 0.2, "poor")], "critical"))
    need = lambda reason, priority: F.struct(F.lit(reason).alias("reason"), F.lit(priority).alias("priority"))
    found = ladder(
        [
            (c > 0.8, need("congestion", "critical")), (F.col("health").isin("poor", "critical"), need("network_degradation", "high")),
            ((u < 0.3) & (F.col("available") > 20), need("underutilization", "medium")), (e < 0.5, need("poor_efficiency", "medium")),
            (c > 0.5, need("congestion", "medium")), ((u < 0.6) & (F.col("available") > 10), need("underutilization", "low")),
        ],
        F.lit(None).cast("struct<reason: string, priority: string>"),
    )
    rows = rows.withColumn("_need", found)
    gain = ladder([(F.col("_need.reason") == "underutilization", (1.0 - u) * 0.5), (F.col("_need.reason") == "congestion", c * 0.3), (F.col("_need.reason") == "poor_efficiency", (1.0 - e) * 0.4), (F.col("_need.reason") == "network_degradation", F.lit(0.2))], F.lit(0.1))
    return rows.withColumns({"reason": F.col("_need.reason"), "priority": F.col("_need.priority"), "improvement": F.least(gain, F.lit(0.5))}).drop("_need")


def long_metrics(rows: DataFrame, ts: str, dimensions: list[str], metrics: list[tuple[str, str]], only_positive: tuple[str, ...] = ()) -> DataFrame:
    """A wide metric table as rows (name, value, unit, ts, dimensions); some metrics only where over zero."""
    each = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit")) for m, u in metrics))
    kept = F.filter(each, lambda x: x["value"].isNotNull() & (~x["name"].isin(*only_positive) | (x["value"] > 0)) if only_positive else x["value"].isNotNull())
    named = F.array_join(F.array(*(F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dimensions)), ",")
    return rows.select(F.explode(kept).alias("m"), F.col(ts).alias("ts"), named.alias("dimensions")).select("m.name", "m.value", "m.unit", "ts", "dimensions")
