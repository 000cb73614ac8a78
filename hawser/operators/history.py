"""Learning from past transfers: sessions, histories, scores, admission and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MIB, bounded, ladder, network_condition, truncated
from .folds import fold


def session_results(chunks: DataFrame, key: str) -> DataFrame:
    """Per session of chunks (position, chunk, throughput): the chunk size with the best throughput (first on ties, then the larger), the
    mean throughput and its condition.
    """
    out = chunks.groupBy(key).agg(F.max_by("chunk", F.struct("throughput", (-F.col("position")).alias("p"), "chunk")).alias("best_chunk"), F.avg("throughput").alias("mean_throughput"), F.count("*").alias("chunks"))
    return out.withColumn("condition", network_condition(F.col("mean_throughput")))


def content_history(sessions: DataFrame) -> DataFrame:
    """Per content type of successful sessions: whole mean of their best chunks."""
    return sessions.where("success").groupBy("content_type").agg(F.expr("sum(best_chunk) div count(*)").cast("long").alias("historical"), F.count("*").alias("sessions"))


def recent_averages(samples: DataFrame, n: int = 100) -> DataFrame:
    """Per link: means of bandwidth and latency over the successful ones of its last `n` samples."""
    back = Window.partitionBy("link").orderBy(F.desc("ts"), F.desc("sample_id"))
    kept = samples.withColumn("_b", F.row_number().over(back)).where(F.col("_b") <= n)
    return kept.groupBy("link").agg(F.avg(F.when(F.col("success"), F.col("bandwidth"))).alias("bandwidth"), F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("latency_ms"))


def banded_mean(wanted: DataFrame, history: DataFrame, share: float = 0.2) -> DataFrame:
    """Mean ratio of the history of a key within `share` of the wanted size; of the whole key where the band is empty.

    The history is summed per key and size first, so that a size is met once, however many rows stand for it.
    """
    sizes = history.groupBy("key", "size").agg(F.sum("ratio").alias("s"), F.count("ratio").alias("n"))
    every = history.groupBy("key").agg(F.avg("ratio").alias("all_mean"))
    asked = wanted.select("key", F.col("size").alias("w")).distinct()
    near = asked.join(sizes, "key").where(F.abs(F.col("size") - F.col("w")) <= F.floor(F.col("w") * share))
    band = near.groupBy("key", "w").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("band_mean"))
    band = band.withColumnsRenamed({"w": "size"})
    out = wanted.join(band, ["key", "size"], "left").join(every, "key", "left")
    return out.withColumn("mean", F.coalesce("band_mean", "all_mean")).drop("band_mean", "all_mean")


def age_weighted(results: DataFrame, key: str, now: Column, days: float = 30.0) -> DataFrame:
    """Per key: mean of ratio with weights falling linearly with age to zero at `days`, 0.1 after."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400e6
    weight = F.when(age > days, 0.1).otherwise(1.0 - age / days)
    return results.groupBy(key).agg(F.try_divide(F.sum(F.col("ratio") * weight), F.sum(weight)).alias("mean"))


def best_codecs(trials: DataFrame, key: str) -> DataFrame:
    """Per key of trials (position, codec, ratio, throughput): best by score (10 x ratio + throughput), fastest, smallest; first wins."""
    first = (-F.col("position")).alias("p")
    return trials.groupBy(key).agg(
        F.max_by("codec", F.struct((F.col("ratio") * 10 + F.col("throughput")).alias("s"), first)).alias("best"),
        F.max_by("codec", F.struct("throughput", first)).alias("fastest"), F.max_by("codec", F.struct("ratio", first)).alias("smallest"),
    )


def global_state(prefixes: DataFrame) -> DataFrame:
    """One row over prefixes (throughput, queue, utilisation, error_rate): sums and means, errors over active ones, network use up to 1."""
    out = prefixes.agg(
        F.sum("throughput").alias("throughput"), F.sum("queue").cast("long").alias("active"), F.try_divide(F.sum("error_rate"), F.count_if(F.col("queue") > 0).cast("double")).alias("error_rate"),
        F.avg("queue").alias("queue_length"), F.avg("utilisation").alias("utilisation"),
    )
    return out.withColumn("network_use", F.least(F.col("throughput") / 1000.0, F.lit(1.0)))


def throughput(groups: DataFrame, seconds: float) -> DataFrame:
    """One row over groups (total_bytes): bytes, and MB/s over the duration (null for none)."""
    total = groups.agg(F.sum("total_bytes").cast("long").alias("total_bytes"))
    return total.withColumn("mb_per_second", F.try_divide(F.col("total_bytes") / float(MIB), F.lit(seconds)))


def network_profile(samples: DataFrame, start: float = 10.0, rate: float = 0.1) -> DataFrame:
    """Per link: an estimate that only new peaks raise (by `rate` of the difference), least latency, and confidence."""

    def step(state, row):
        estimate, least, n = state
        if row.bandwidth > estimate:
            estimate = (1 - rate) * estimate + rate * row.bandwidth
        if row.latency_ms > 0 and (least is None or row.latency_ms < least):
            least = row.latency_ms
        return (estimate, least, n + 1), []

    close = lambda s: [(s[0], s[1], min(0.5 + 0.01 * s[2], 1.0))]
    rows = samples.select("link", "ts", "sample_id", "bandwidth", "latency_ms")
    return fold(rows, "link", ["ts", "sample_id"], lambda: (start, None, 0), step, close, "link long, estimate double, baseline_ms double, confidence double")


def adaptation_scores(rows: DataFrame) -> DataFrame:
    """How near chunk_mb, concurrency and codec are to the best for a row's condition: 0 to 1 each, and their mean."""
    c = F.col
    bdp = truncated(c("bandwidth") * (c("latency_ms") / 1000.0) * (1.0 - c("congestion") * 0.5) * (1.0 - c("loss") * 10.0))
    best_chunk = F.greatest(F.least(bdp, F.lit(100)), F.lit(5))
    streams = truncated(c("bandwidth") / 25.0)
    streams = F.when(c("congestion") > 0.3, truncated(streams * (1.0 - c("congestion")))).otherwise(streams)
    streams = F.when(c("latency_ms") > 100, F.greatest(streams - 1, F.lit(1))).otherwise(streams)
    best_streams = F.greatest(F.least(streams, F.lit(8)), F.lit(1))
    level = lambda codec: ladder([(codec == n, i) for i, n in enumerate(("zstd-fast", "zstd", "zstd-high", "zstd-max"), 1)], F.lit(None).cast("int"))
    best_codec = ladder([(c("bandwidth") > 100, "zstd-fast"), (c("bandwidth") < 20, "zstd-high"), (c("latency_ms") > 100, "zstd-high")], "zstd")
    rows = rows.withColumns({
        "chunk_score": 1.0 - F.abs(c("chunk_mb") - best_chunk) / 95.0, "concurrency_score": 1.0 - F.abs(c("concurrency") - best_streams) / 7.0,
        "codec_score": F.coalesce(1.0 - F.abs(level(c("codec")) - level(best_codec)) / 3.0, F.lit(0.5)),
    })
    return rows.withColumn("score", bounded((c("chunk_score") + c("concurrency_score") + c("codec_score")) / 3.0, 0.0, 1.0))


def effective_bandwidth(bandwidth: Column, congestion: Column, loss: Column, jitter: Column) -> Column:
    """Bandwidth less congestion, loss and jitter over 10 ms; a tenth of it at least."""
    return F.greatest(bandwidth * (1.0 - congestion * 0.5) * (1.0 - loss * 5.0) * F.when(jitter > 10, 0.9).otherwise(1.0), bandwidth * 0.1)


def expected_throughput(bandwidth: Column, congestion: Column, loss: Column, concurrency: int) -> Column:
    """What a session should reach; 25 where nothing is known."""
    share = 0.8 + 0.2 / concurrency if concurrency > 1 else 1.0
    return F.when(bandwidth.isNull(), 25.0).otherwise(F.greatest(bandwidth * share * (1.0 - congestion * 0.5) * (1.0 - loss * 10.0), bandwidth * 0.1))


def session_needs(samples: DataFrame, concurrency: int = 4) -> DataFrame:
    """Whether a link's last five samples ask for adapting: declining (over 10 % from the earlier to the later half) wins over poor."""
    order = Window.partitionBy("link").orderBy(F.desc("ts"), F.desc("sample_id"))
    five = samples.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= 5).withColumn("_n", F.count("*").over(Window.partitionBy("link")))
    late = F.col("_b") <= F.col("_n") - F.floor(F.col("_n") / 2)
    expected = expected_throughput(F.col("bandwidth"), F.col("congestion"), F.col("loss"), concurrency)
    out = five.groupBy("link").agg(
        F.count("*").alias("n"), F.avg("bandwidth").alias("mean"), F.avg(F.when(~late, F.col("bandwidth"))).alias("early"), F.avg(F.when(late, F.col("bandwidth"))).alias("late"),
        F.max(F.when(F.col("_b") == 1, expected)).alias("expected"),
    )
    trend = F.try_divide(F.col("late") - F.col("early"), F.col("early"))
    reason = ladder([(F.col("n") < 2, F.lit(None).cast("string")), (trend < -0.1, "declining_performance"), (F.col("mean") < F.col("expected") * 0.7, "poor_performance")], F.lit(None).cast("string"))
    return out.select("link", "mean", "expected", reason.alias("reason"))


def admitted(uploads: DataFrame, key: str, order: str, depth: int) -> DataFrame:
    """`uploads` with admitted: whether each is among the first `depth` of its prefix by `order`."""
    return uploads.withColumn("admitted", F.row_number().over(Window.partitionBy(key).orderBy(order)) <= depth)


def in_flight(events: DataFrame, key: str, window: int) -> DataFrame:
    """Running uploads of a key at each event (+1 start, -1 end), and whether a start then was within the window."""
    w = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("in_flight", F.sum("change").over(w).cast("long"))
    return out.withColumn("admit", (F.col("change") < 0) | (F.col("in_flight") <= window))


def progress(rows: DataFrame) -> DataFrame:
    """Rows (done, total, elapsed seconds): percent, MB/s and seconds left; null where nothing is known."""
    percent = F.try_divide(F.col("done") * 100.0, F.col("total"))
    rows = rows.withColumn("percent", percent).withColumn("mb_per_second", F.try_divide(F.col("done") / float(MIB), F.col("elapsed")))
    return rows.withColumn("left", F.when((percent > 0) & (percent < 100), F.try_divide(F.col("elapsed"), percent / 100) - F.col("elapsed")))


def retry_schedule(operations: DataFrame, attempts: int = 3, first_ms: int = 1000, most_ms: int = 30000) -> DataFrame:
    """Per operation (retryable): its attempts and the wait before each; one attempt where a retry doesn't help."""
    n = F.when(F.col("retryable"), attempts).otherwise(1)
    rows = operations.withColumn("attempt", F.explode(F.sequence(F.lit(1), n)))
    return rows.withColumn("wait_ms", F.when(F.col("attempt") == 1, 0.0).otherwise(F.least(first_ms * F.pow(F.lit(2.0), F.col("attempt") - 2), F.lit(float(most_ms)))))


def region_errors(results: DataFrame) -> DataFrame:
    """Per region of results (ok): error percent, and degraded over 25 %."""
    out = results.groupBy("region").agg(F.count("*").alias("uploads"), F.count_if(~F.col("ok")).alias("failed"))
    return out.withColumn("error_percent", F.try_divide(F.col("failed") * 100.0, F.col("uploads"))).withColumn("status", F.when(F.col("error_percent") > 25, "degraded").otherwise("healthy"))


def pattern_boundaries(patterns: DataFrame, key: str, target: int) -> DataFrame:
    """Boundaries of a key's patterns (offset, length, type, compressibility): at changes of type where the chunk since
    the last cut holds target/2 to 3 x target, and at ends of patterns over 0.8 compressible. The cut position is
    carried along a key's patterns in order.
    """

    def step(state, row):
        start, last, found = *state, []
        if last is not None and row.type != last and target // 2 <= row.offset - start <= 3 * target:
            found.append((start, row.offset, "transition"))
            start = row.offset
        end = row.offset + row.length
        if row.compressibility > 0.8 and end - start >= target // 2:
            found.append((start, end, "compressible"))
        return (start, row.type), found

    rows = patterns.select(key, "offset", "length", "type", "compressibility")
    return fold(rows, key, ["offset", "length", "type"], lambda: (0, None), step, lambda s: [], f"{key} long, start long, stop long, why string")


def pattern_alignment(boundaries: DataFrame, patterns: DataFrame, key: str, tolerance: int = 1024) -> DataFrame:
    """How well each boundary (key, stop) meets the transitions of its key's patterns (offset, compressibility).

    A transition is where a pattern other than the first begins; within `tolerance` it scores its nearness times the
    change of compressibility, and a boundary takes the mean, 0.5 if no transition is near. Both sides are dealt by key
    and cells of `tolerance`, so a boundary meets the three cells around it and not all transitions of its key.
    Repeated boundaries give one row; a null key or stop is near nothing.
    """
    before = F.lag("compressibility").over(Window.partitionBy(key).orderBy("offset", "compressibility"))
    cell = lambda x: F.floor(F.col(x) / tolerance).cast("long")
    transitions = patterns.select(key, "offset", F.abs(F.col("compressibility") - before).alias("_change")).where("_change is not null")
    transitions = transitions.select(F.col(key).alias("_key"), cell("offset").alias("_cell"), "offset", "_change")
    around = F.explode_outer(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: cell("stop") + i))
    dealt = boundaries.select(key, "stop").distinct().select(key, "stop", around.alias("_at"))
    distance = F.abs(F.col("stop") - F.col("offset"))
    met = dealt.join(transitions, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_cell")), "left")
    score = F.when(distance <= tolerance, (1 - distance / tolerance) * F.col("_change"))
    return met.groupBy(key, "stop").agg(F.coalesce(F.avg(score), F.lit(0.5)).alias("alignment"))


def alternatives(per_link: DataFrame, samples: DataFrame) -> DataFrame:
    """For links whose last five fell under 0.7 of their history: the link with the best recent mean over 1.2 times theirs.

    The best link is one row, so no link is compared with every other.
    """
    order = Window.partitionBy("link").orderBy(F.desc("ts"), F.desc("sample_id"))
    five = samples.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= 5).groupBy("link").agg(F.avg("bandwidth").alias("last_five"))
    rows = per_link.join(five, "link")
    best = rows.agg(F.max_by(F.struct("link", "recent"), F.struct("recent", (-F.col("link")).alias("l"))).alias("_best"))
    out = rows.join(F.broadcast(best))  # one row
    weak = (F.col("last_five") < F.col("overall") * 0.7) & (F.col("_best.link") != F.col("link")) & (F.col("_best.recent") > F.col("last_five") * 1.2)
    return out.select("link", F.when(weak, F.col("_best.link")).otherwise(F.col("link")).alias("chosen"))


def first_price(terms: Column) -> Column:
    """First parseable USD price in terms.OnDemand.*.priceDimensions.*.pricePerUnit.USD of a price-list product."""
    shape = "struct<terms: struct<OnDemand: map<string, struct<priceDimensions: map<string, struct<pricePerUnit: struct<USD: string>>>>>>>"
    offers = F.map_values(F.from_json(terms, shape)["terms"]["OnDemand"])
    prices = F.flatten(F.transform(offers, lambda o: F.transform(F.map_values(o["priceDimensions"]), lambda p: p["pricePerUnit"]["USD"].try_cast("double"))))
    return F.get(F.filter(prices, lambda p: p.isNotNull()), 0)
