"""Queries over histories, sessions and predictions, each with its SQL. Floats are rounded to six decimals on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import SQL_ARCHIVES, SQL_FILES, SQL_PRICES, SQL_REGIONS, SQL_SAMPLES, archives, files, prices, regions, samples, table
from ..operators import content, cost, history, inventory, routing, transfer
from ..sources import inventories
from .batch import r6, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SESSIONS = "c AS (SELECT l_orderkey, l_linenumber AS position, CAST(l_quantity AS BIGINT) * 1048576 AS chunk, l_discount * 400 AS throughput FROM lineitem)"


def _chunks(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), (F.col("l_quantity").cast("long") * 1048576).alias("chunk"), (F.col("l_discount") * 400).alias("throughput"))


@query("a13_session_results", f"WITH {_SESSIONS}, b AS (SELECT l_orderkey, chunk FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY throughput DESC, position, chunk DESC) = 1), m AS (SELECT l_orderkey, round(avg(throughput), 6) AS mean_throughput, count(*) AS chunks FROM c GROUP BY 1) SELECT l_orderkey, chunk AS best_chunk, mean_throughput, chunks, CASE WHEN mean_throughput < 1 THEN 'poor' WHEN mean_throughput < 5 THEN 'fair' WHEN mean_throughput < 25 THEN 'good' ELSE 'excellent' END AS condition FROM m JOIN b USING (l_orderkey)")
def _(spark, d):
    return rounded(history.session_results(_chunks(spark, d), "l_orderkey"), "mean_throughput")


@query("a11_content_history", f"WITH {_SESSIONS}, b AS (SELECT l_orderkey, chunk FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY throughput DESC, position, chunk DESC) = 1) SELECT CASE l_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'video' ELSE 'binary' END AS content_type, CAST(sum(chunk) // count(*) AS BIGINT) AS historical, count(*) AS sessions FROM b WHERE l_orderkey % 7 <> 0 GROUP BY 1")
def _(spark, d):
    s = history.session_results(_chunks(spark, d), "l_orderkey")
    kind = F.when(F.col("l_orderkey") % 3 == 0, "text").when(F.col("l_orderkey") % 3 == 1, "video").otherwise("binary")
    return history.content_history(s.select(kind.alias("content_type"), "best_chunk", (F.col("l_orderkey") % 7 != 0).alias("success")))


@query("a10_recent_averages", f"WITH {SQL_SAMPLES}, k AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY link ORDER BY ts DESC, sample_id DESC) <= 100) SELECT link, round(avg(bandwidth) FILTER (success), 6) AS bandwidth, round(avg(latency_ms) FILTER (success), 6) AS latency_ms FROM k GROUP BY 1")
def _(spark, d):
    return rounded(history.recent_averages(samples(spark, d)), "bandwidth", "latency_ms")


@query("j09_banded_mean", "WITH h AS (SELECT p_type AS key, CAST(p_size AS BIGINT) AS size, CAST(round(p_retailprice * 100) AS BIGINT) AS ratio FROM part), w AS (SELECT p_partkey, p_type AS key, CAST(p_size * 3 % 70 AS BIGINT) AS size FROM part), a AS (SELECT key, avg(ratio) AS m FROM h GROUP BY 1), b AS (SELECT p_partkey, avg(ratio) AS m FROM w JOIN h ON h.key = w.key AND abs(h.size - w.size) <= floor(w.size * 0.2::DOUBLE) GROUP BY 1) SELECT w.p_partkey, round(coalesce(b.m, a.m), 6) AS mean FROM w LEFT JOIN b USING (p_partkey) LEFT JOIN a ON a.key = w.key")
def _(spark, d):
    parts = table(spark, d, "part")
    past = parts.select(F.col("p_type").alias("key"), F.col("p_size").cast("long").alias("size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("ratio"))
    wanted = parts.select("p_partkey", F.col("p_type").alias("key"), (F.col("p_size") * 3 % 70).cast("long").alias("size"))
    return history.banded_mean(wanted, past).select("p_partkey", F.round("mean", 6).alias("mean"))


@query("a33_age_weighted", "WITH a AS (SELECT user_id, value AS ratio, (epoch(TIMESTAMP '2024-02-10 00:00:00') - epoch(ts)) / 86400.0::DOUBLE AS age FROM events) SELECT user_id, round(sum(ratio * CASE WHEN age > 30 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE - age / 30.0::DOUBLE END) / sum(CASE WHEN age > 30 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE - age / 30.0::DOUBLE END), 4) AS mean FROM a GROUP BY 1")
def _(spark, d):
    past = table(spark, d, "events").select("user_id", "ts", F.col("value").alias("ratio"))
    return history.age_weighted(past, "user_id", F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")).select("user_id", F.round("mean", 4).alias("mean"))


@query("a31_best_codecs", "WITH t AS (SELECT l_orderkey, l_linenumber AS p, CASE l_linenumber % 4 WHEN 0 THEN 'zstd' WHEN 1 THEN 'lz4' WHEN 2 THEN 'gzip' ELSE 's2' END AS codec, l_discount AS ratio, l_quantity AS throughput FROM lineitem), x AS (SELECT DISTINCT l_orderkey FROM t) SELECT l_orderkey, (SELECT codec FROM t WHERE t.l_orderkey = x.l_orderkey ORDER BY ratio * 10 + throughput DESC, p, codec DESC LIMIT 1) AS best, (SELECT codec FROM t WHERE t.l_orderkey = x.l_orderkey ORDER BY throughput DESC, p LIMIT 1) AS fastest, (SELECT codec FROM t WHERE t.l_orderkey = x.l_orderkey ORDER BY ratio DESC, p LIMIT 1) AS smallest FROM x")
def _(spark, d):
    codec = F.element_at(F.array(*map(F.lit, ["zstd", "lz4", "gzip", "s2"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), codec.alias("codec"), F.col("l_discount").alias("ratio"), F.col("l_quantity").alias("throughput"))
    return history.best_codecs(t, "l_orderkey")


@query("a16_global_state", "WITH p AS (SELECT l_suppkey % 16 AS p, avg(l_quantity) AS t, count(*) % 13 AS q, avg(l_discount) AS u, avg(l_tax) AS e FROM lineitem GROUP BY 1) SELECT round(sum(t), 6) AS throughput, CAST(sum(q) AS BIGINT) AS active, round(sum(e) / count(*) FILTER (q > 0), 6) AS error_rate, round(avg(q), 6) AS queue_length, round(avg(u), 6) AS utilisation, round(least(sum(t) / 1000.0::DOUBLE, 1.0::DOUBLE), 6) AS network_use FROM p")
def _(spark, d):
    p = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("p")).agg(F.avg("l_quantity").alias("throughput"), (F.count("*") % 13).alias("queue"), F.avg("l_discount").alias("utilisation"), F.avg("l_tax").alias("error_rate"))
    return rounded(history.global_state(p), "throughput", "error_rate", "queue_length", "utilisation", "network_use")


@query("a06_throughput", f"WITH {SQL_ARCHIVES} SELECT CAST(sum(size) AS BIGINT) AS total_bytes, round(CAST(sum(size) AS DOUBLE) / 1048576.0::DOUBLE / 3600.0::DOUBLE, 6) AS mb_per_second FROM archives")
def _(spark, d):
    groups = archives(spark, d).groupBy(F.col("owner") % 8).agg(F.sum("size").alias("total_bytes"))
    return rounded(history.throughput(groups, 3600.0), "mb_per_second")


@query("w14_network_profile", f"WITH {SQL_SAMPLES}, l AS (SELECT link, list(bandwidth ORDER BY ts, sample_id) AS v, min(latency_ms) FILTER (latency_ms > 0) AS baseline_ms, least(0.5::DOUBLE + 0.01::DOUBLE * count(*), 1.0::DOUBLE) AS confidence FROM samples GROUP BY 1) SELECT link, round(list_reduce(list_prepend(10.0::DOUBLE, v), lambda m, x: CASE WHEN x > m THEN 0.9::DOUBLE * m + 0.1::DOUBLE * x ELSE m END), 6) AS estimate, baseline_ms, round(confidence, 6) AS confidence FROM l")
def _(spark, d):
    return rounded(history.network_profile(samples(spark, d)), "estimate", "confidence")


@query("x23_adaptation_scores", f"""WITH {SQL_SAMPLES}, z AS (SELECT *, least(greatest(CAST(trunc(bandwidth * (latency_ms / 1000.0::DOUBLE) * (1.0::DOUBLE - congestion * 0.5::DOUBLE) * (1.0::DOUBLE - loss * 10.0::DOUBLE)) AS BIGINT), 5), 100) AS bc, CAST(trunc(bandwidth / 25.0::DOUBLE) AS BIGINT) AS s0 FROM samples),
  s AS (SELECT *, CASE WHEN congestion > 0.3::DOUBLE THEN CAST(trunc(s0 * (1.0::DOUBLE - congestion)) AS BIGINT) ELSE s0 END AS s1 FROM z), t AS (SELECT *, greatest(least(CASE WHEN latency_ms > 100 THEN greatest(s1 - 1, 1) ELSE s1 END, 8), 1) AS bs, CASE WHEN bandwidth > 100 THEN 1 WHEN bandwidth < 20 THEN 3 WHEN latency_ms > 100 THEN 3 ELSE 2 END AS bl FROM s)
  SELECT sample_id, round(1.0::DOUBLE - abs(24 - bc) / 95.0::DOUBLE, 6) AS chunk_score, round(1.0::DOUBLE - abs(4 - bs) / 7.0::DOUBLE, 6) AS concurrency_score, round(1.0::DOUBLE - abs(2 - bl) / 3.0::DOUBLE, 6) AS codec_score,
  round(greatest(least(((1.0::DOUBLE - abs(24 - bc) / 95.0::DOUBLE) + (1.0::DOUBLE - abs(4 - bs) / 7.0::DOUBLE) + (1.0::DOUBLE - abs(2 - bl) / 3.0::DOUBLE)) / 3.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 6) AS score FROM t""")
def _(spark, d):
    rows = samples(spark, d).withColumns({"chunk_mb": F.lit(24), "concurrency": F.lit(4), "codec": F.lit("zstd")})
    return rounded(history.adaptation_scores(rows).select("sample_id", "chunk_score", "concurrency_score", "codec_score", "score"), "chunk_score", "concurrency_score", "codec_score", "score")


@query("x22_effective_bandwidth", f"WITH {SQL_SAMPLES} SELECT sample_id, round(greatest(bandwidth * (1.0::DOUBLE - congestion * 0.5::DOUBLE) * (1.0::DOUBLE - loss * 5.0::DOUBLE) * CASE WHEN latency_ms * 0.1::DOUBLE > 10 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, bandwidth * 0.1::DOUBLE), 8) AS effective, round(greatest(bandwidth * (0.8::DOUBLE + 0.2::DOUBLE / 4) * (1.0::DOUBLE - congestion * 0.5::DOUBLE) * (1.0::DOUBLE - loss * 10.0::DOUBLE), bandwidth * 0.1::DOUBLE), 8) AS expected FROM samples")
def _(spark, d):
    c = F.col
    e, x = history.effective_bandwidth(c("bandwidth"), c("congestion"), c("loss"), c("latency_ms") * 0.1), history.expected_throughput(c("bandwidth"), c("congestion"), c("loss"), 4)
    return samples(spark, d).select("sample_id", F.round(e, 8).alias("effective"), F.round(x, 8).alias("expected"))


@query("f14_session_needs", f"""WITH {SQL_SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ts DESC, sample_id DESC) AS b FROM samples QUALIFY b <= 5), n AS (SELECT *, count(*) OVER (PARTITION BY link) AS n FROM k),
  g AS (SELECT link, max(n) AS n, avg(bandwidth) AS mean, avg(bandwidth) FILTER (b > n - n // 2) AS early, avg(bandwidth) FILTER (b <= n - n // 2) AS late, max(CASE WHEN b = 1 THEN greatest(bandwidth * (0.8::DOUBLE + 0.2::DOUBLE / 4) * (1.0::DOUBLE - congestion * 0.5::DOUBLE) * (1.0::DOUBLE - loss * 10.0::DOUBLE), bandwidth * 0.1::DOUBLE) END) AS expected FROM n GROUP BY 1)
  SELECT link, {r6('mean', 'expected')}, CASE WHEN n < 2 THEN NULL WHEN (late - early) / early < -0.1 THEN 'declining_performance' WHEN mean < expected * 0.7 THEN 'poor_performance' END AS reason FROM g""")
def _(spark, d):
    return rounded(history.session_needs(samples(spark, d)), "mean", "expected")


@query("t06_admitted", f"WITH {SQL_ARCHIVES}, a AS (SELECT id, row_number() OVER (PARTITION BY owner % 64 ORDER BY id) <= 16 AS admitted FROM archives) SELECT admitted, count(*) AS uploads, CAST(sum(id) AS BIGINT) AS ids FROM a GROUP BY 1")
def _(spark, d):
    a = history.admitted(archives(spark, d).withColumn("prefix", F.col("owner") % 64), "prefix", "id", 16)
    return a.groupBy("admitted").agg(F.count("*").alias("uploads"), F.sum("id").alias("ids"))


@query("t03_in_flight", "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS c FROM events), s AS (SELECT event_id, c, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM e) SELECT event_id AS id, in_flight, c < 0 OR in_flight <= 4 AS admit FROM s")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("change"))
    return history.in_flight(e, "user_id", 4).select("id", "in_flight", "admit")


@query("p09_progress", f"WITH {SQL_ARCHIVES}, p AS (SELECT id, CAST(id % 101 AS BIGINT) AS done, CAST(100 AS BIGINT) AS total, CAST(id % 977 AS DOUBLE) AS elapsed FROM archives) SELECT id, round(done * 100.0::DOUBLE / total, 6) AS percent, CASE WHEN elapsed > 0 THEN round(done / 1048576.0::DOUBLE / elapsed, 9) END AS mb_per_second, CASE WHEN done > 0 AND done < 100 THEN round(elapsed / (done * 100.0::DOUBLE / total / 100) - elapsed, 6) END AS \"left\" FROM p")
def _(spark, d):
    rows = archives(spark, d).select("id", (F.col("id") % 101).alias("done"), F.lit(100).cast("long").alias("total"), (F.col("id") % 977).cast("double").alias("elapsed"))
    p = history.progress(rows)
    return p.select("id", F.round("percent", 6).alias("percent"), F.round("mb_per_second", 9).alias("mb_per_second"), F.round("left", 6).alias("left"))


@query("t21_retry_schedule", "WITH o AS (SELECT event_id, event_id % 5 <> 0 AS retryable FROM events WHERE event_type = 'error'), a AS (SELECT event_id, unnest(CASE WHEN retryable THEN [1, 2, 3] ELSE [1] END) AS attempt FROM o) SELECT event_id, attempt, CASE WHEN attempt = 1 THEN 0.0::DOUBLE ELSE least(1000 * pow(2.0::DOUBLE, attempt - 2), 30000.0::DOUBLE) END AS wait_ms FROM a")
def _(spark, d):
    o = table(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 5 != 0).alias("retryable"))
    return history.retry_schedule(o).select("event_id", "attempt", "wait_ms")


@query("a29_region_errors", "WITH g AS (SELECT concat('NATION_', user_id % 25) AS region, count(*) AS uploads, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1) SELECT region, uploads, failed, round(failed * 100.0::DOUBLE / uploads, 6) AS error_percent, CASE WHEN failed * 100.0::DOUBLE / uploads > 25 THEN 'degraded' ELSE 'healthy' END AS status FROM g")
def _(spark, d):
    r = table(spark, d, "events").select(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("region"), (F.col("event_type") != "error").alias("ok"))
    return rounded(history.region_errors(r), "error_percent")


@query("d08_pattern_boundaries")
def _(spark, d):
    from pyspark.sql import Window

    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.element_at(F.array(*map(F.lit, ["text", "repetitive", "random"])), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(before), F.lit(0)).alias("offset"), F.col("l_quantity").cast("long").alias("length"), kind.alias("type"), (F.col("l_discount") * 10).alias("compressibility"))
    return history.pattern_boundaries(rows, "l_orderkey", 40)


@query(
    "j08_pattern_alignment",
    """WITH p AS (SELECT l_orderkey, coalesce(sum(CAST(l_quantity AS BIGINT) * 64) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts, CAST(l_quantity AS BIGINT) * 64 AS length, CAST(l_discount * 10 AS DOUBLE) AS compressibility FROM lineitem),
    t AS (SELECT l_orderkey, starts, abs(compressibility - lag(compressibility) OVER (PARTITION BY l_orderkey ORDER BY starts, compressibility)) AS change FROM p),
    e AS (SELECT l_orderkey, max(starts + length) AS total FROM p GROUP BY 1),
    b AS (SELECT l_orderkey, unnest(generate_series(2048, CAST(total AS BIGINT), 2048)) AS stop FROM e)
    SELECT b.l_orderkey, b.stop, round(coalesce(avg((1 - abs(b.stop - t.starts) / 1024.0::DOUBLE) * t.change), 0.5::DOUBLE), 9) AS alignment
    FROM b LEFT JOIN t ON b.l_orderkey = t.l_orderkey AND t.change IS NOT NULL AND abs(b.stop - t.starts) <= 1024 GROUP BY 1, 2""",
)
def _(spark, d):
    """Boundaries at every 2048 bytes of an order against the transitions between its lines. Nine decimals, as halves of the sixth occur."""
    from pyspark.sql import Window

    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("l_quantity").cast("long") * 64
    patterns = table(spark, d, "lineitem").select("l_orderkey", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"), size.alias("length"), (F.col("l_discount") * 10).cast("double").alias("compressibility"))
    total = patterns.groupBy("l_orderkey").agg(F.max(F.col("offset") + F.col("length")).alias("total")).where("total >= 2048")
    boundaries = total.select("l_orderkey", F.explode(F.sequence(F.lit(2048).cast("long"), F.col("total"), F.lit(2048).cast("long"))).alias("stop"))
    return history.pattern_alignment(boundaries, patterns, "l_orderkey").withColumn("alignment", F.round("alignment", 9))


@query("w18_alternatives", f"WITH {SQL_SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ts DESC, sample_id DESC) AS b FROM samples QUALIFY b <= 20), p AS (SELECT link, avg(bandwidth) FILTER (b <= 3) AS recent, avg(bandwidth) FILTER (b <= 5) AS five, avg(bandwidth) AS overall FROM k GROUP BY 1 HAVING count(*) >= 5), x AS (SELECT link AS l, recent AS r FROM p ORDER BY recent DESC, link LIMIT 1) SELECT link, CASE WHEN five < overall * 0.7 AND l <> link AND r > five * 1.2 THEN l ELSE link END AS chosen FROM p, x")
def _(spark, d):
    s = samples(spark, d)
    return history.alternatives(transfer.recent_against_history(s), s)


@query("x31_first_prices", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_retailprice AS DOUBLE) END AS price FROM part")
def _(spark, d):
    usd = F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    doc = F.concat(F.lit('{"terms":{"OnDemand":{"o":{"priceDimensions":{"a":{"pricePerUnit":{"USD":"none"}},"d":{"pricePerUnit":{"USD":"'), usd, F.lit('"}}}}}}}'))
    return table(spark, d, "part").select("p_partkey", history.first_price(doc).alias("price"))


@query("j01_storage_costs", f"WITH {SQL_ARCHIVES}, {SQL_PRICES}, a AS (SELECT id, size, CASE id % 4 WHEN 0 THEN 'GLACIER' WHEN 1 THEN 'STANDARD_IA' WHEN 2 THEN 'NO_SUCH_CLASS' ELSE 'DEEP_ARCHIVE' END AS class FROM archives) SELECT id, round(size / 1073741824.0::DOUBLE * CASE WHEN class = 'GLACIER' THEN 0.005::DOUBLE ELSE coalesce(storage, 0.023::DOUBLE) END, 9) AS usd FROM a LEFT JOIN prices USING (class)")
def _(spark, d):
    cls = F.element_at(F.array(*map(F.lit, ["GLACIER", "STANDARD_IA", "NO_SUCH_CLASS", "DEEP_ARCHIVE"])), (F.col("id") % 4 + 1).cast("int"))
    service = prices(spark).where("class = 'GLACIER'").select("class", F.lit(0.005).alias("service"))
    rows = archives(spark, d).select("id", "size", cls.alias("class")).join(F.broadcast(service), "class", "left").join(F.broadcast(prices(spark)), "class", "left")
    return rows.select("id", F.round(F.col("size") / F.lit(float(S.GIB)) * F.coalesce("service", "storage", F.lit(0.023)), 9).alias("usd"))


@query("x16_predicted_ratios", "WITH p AS (SELECT p_partkey, CAST(p_size % 9 AS DOUBLE) AS e, p_partkey % 3 AS k, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS h FROM part), n AS (SELECT *, CASE WHEN e < 1 THEN 0.9::DOUBLE WHEN e < 2 THEN 0.8::DOUBLE WHEN e < 4 THEN 0.6::DOUBLE WHEN e < 6 THEN 0.4::DOUBLE WHEN e < 7 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END * 0.4::DOUBLE + CASE k WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.02::DOUBLE ELSE 0.3::DOUBLE END * 0.4::DOUBLE + 0.06::DOUBLE AS now FROM p) SELECT p_partkey, round(greatest(least(CASE WHEN h > 0 THEN now * 0.7::DOUBLE + h * 0.3::DOUBLE ELSE now END, 0.95::DOUBLE), 0.05::DOUBLE), 6) AS ratio FROM n")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["text", "zip", "pdf"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    r = content.predicted_ratio((F.col("p_size") % 9).cast("double"), kind, F.lit(0.3), F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(0.5))
    return table(spark, d, "part").select("p_partkey", F.round(r, 6).alias("ratio"))


@query("x18_codec_benefit", f"WITH {SQL_SAMPLES} SELECT sample_id, CASE WHEN bandwidth > 100 THEN 'zstd-fast' WHEN bandwidth < 20 THEN 'zstd-high' WHEN latency_ms > 100 THEN 'zstd-high' ELSE 'zstd' END AS codec, round(10.0::DOUBLE / bandwidth * 0.4::DOUBLE - 10.0::DOUBLE / CASE WHEN bandwidth > 100 THEN 300 WHEN bandwidth < 20 OR latency_ms > 100 THEN 50 ELSE 150 END, 6) AS benefit FROM samples WHERE bandwidth > 0")
def _(spark, d):
    codec = S.adaptive_codec(F.col("bandwidth"), F.col("latency_ms"))
    saved = F.lit(10.0) / F.col("bandwidth") * 0.4 - S.codec_seconds(F.lit(10 * S.MIB), codec)
    return samples(spark, d).where("bandwidth > 0").select("sample_id", codec.alias("codec"), F.round(saved, 6).alias("benefit"))


@query("x28_alignment_scores", f"WITH {SQL_ARCHIVES} SELECT id, round(least(CASE WHEN id % 2 = 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN size // 100 BETWEEN 5242880 AND 104857600 THEN 0.3::DOUBLE ELSE 0 END + greatest(1.0::DOUBLE - abs(size // 100 - 33554432.0::DOUBLE) / 33554432.0::DOUBLE, 0.0::DOUBLE) * 0.3::DOUBLE, 1.0::DOUBLE), 6) AS alignment, round(0.5::DOUBLE * 0.4::DOUBLE + 0.25::DOUBLE * 0.3::DOUBLE + greatest(1.0::DOUBLE - abs(size // 100 - 33554432.0::DOUBLE) / 33554432.0::DOUBLE, 0.0::DOUBLE) * 0.3::DOUBLE, 6) AS composite FROM archives")
def _(spark, d):
    size = F.expr("size div 100")
    return archives(spark, d).select("id", F.round(content.alignment_score(size, F.col("id") % 2 == 0, 33554432.0), 6).alias("alignment"), F.round(content.composite_score(F.lit(0.5), F.lit(0.25), size, 33554432.0), 6).alias("composite"))


@query("a26_accuracy", f"WITH {SQL_SAMPLES} SELECT link, round(coalesce(avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.5::DOUBLE), 6) AS accuracy, round(least(0.2::DOUBLE, count(*) / 100.0::DOUBLE * 0.2::DOUBLE), 6) AS bonus FROM samples GROUP BY 1")
def _(spark, d):
    g = samples(spark, d).groupBy("link").agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.5)).alias("accuracy"), F.least(F.lit(0.2), F.count("*") / 100.0 * 0.2).alias("bonus"))
    return rounded(g, "accuracy", "bonus")


@query("a27_requests_by_region", f"WITH {SQL_ARCHIVES}, {SQL_REGIONS} SELECT name AS region, status, count(*) AS requests FROM archives JOIN regions ON priority = id % 25 GROUP BY ROLLUP (name, status) HAVING status IS NOT NULL OR name IS NULL")
def _(spark, d):
    joined = archives(spark, d).join(F.broadcast(regions(spark, d)), F.col("priority") == F.col("id") % 25)
    return joined.rollup(F.col("name").alias("region"), "status").agg(F.count("*").alias("requests")).where("status is not null or region is null")


@query("f06_alternative_regions", f"WITH {SQL_REGIONS} SELECT name, priority FROM regions WHERE status = 'healthy' AND name <> 'NATION_3'")
def _(spark, d):
    return routing.alternatives(regions(spark, d), "NATION_3").select("name", "priority")


@query("o03_directories", f"WITH {SQL_FILES} SELECT DISTINCT regexp_replace(substr(destination, 1, strpos(lower(destination), '/en/') + 3), '/$', '') AS directory FROM files WHERE contains(lower(regexp_extract(destination, '^(.*/)[^/]*$', 1)), '/en/')")
def _(spark, d):
    return inventory.matching_directories(files(spark, d), "/EN/")


@query("u07_inverted_names", "SELECT n_name AS k, CAST(n_nationkey AS VARCHAR) AS v FROM nation")
def _(spark, d):
    m = table(spark, d, "nation").select(F.create_map(F.col("n_nationkey").cast("string"), "n_name").alias("m"))
    return m.select(F.explode(F.map_from_arrays(F.map_values("m"), F.map_keys("m"))).alias("k", "v"))


@query("p11_connection_strings", "SELECT n_nationkey, concat(':s3,key=''', n_name, ''',region=''', n_regionkey, ''':') AS text FROM nation")
def _(spark, d):
    m = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("key"), F.col("n_name"))
    parts = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'")))
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit(":s3,"), F.array_join(parts, ","), F.lit(":")).alias("text"))


@query("k16_metric_batches", "WITH m AS (SELECT l_suppkey AS s, concat('m', l_linenumber) AS name, l_shipdate AS ts, l_orderkey, l_partkey FROM lineitem), b AS (SELECT s, CAST(ceil(row_number() OVER (PARTITION BY s ORDER BY name, ts) / 20.0::DOUBLE) AS BIGINT) AS batch FROM m) SELECT s, batch, count(*) AS n FROM b GROUP BY 1, 2")
def _(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_shipdate").alias("ts"))
    return inventories.metric_batches(m, "s").groupBy("s", "batch").agg(F.count("*").alias("n"))


@query("x40_recovery_options", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'throttling' ELSE 'unknown' END AS category, CASE event_id % 3 WHEN 0 THEN 'check the connection' WHEN 1 THEN 'lower the concurrency' ELSE 'see the log' END AS advice FROM events WHERE event_type = 'error'")
def _(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["dns lookup", "rate limit hit", "odd"])), (F.col("event_id") % 3 + 1).cast("int"))
    advice = spark.createDataFrame([("network", "check the connection"), ("throttling", "lower the concurrency"), ("permission", "check the rights"), ("validation", "check the input")], "category string, advice string")
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", S.error_category(text)["category"].alias("category"))
    return rows.join(F.broadcast(advice), "category", "left").select("event_id", "category", F.coalesce("advice", F.lit("see the log")).alias("advice"))


_NAMES = ["General Purpose", "Infrequent Access", "One Zone - Infrequent Access", "Archive", "Deep Archive", "Intelligent-Tiering", "Outposts"]


@query("x32_price_classes", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'STANDARD_IA' WHEN 2 THEN 'ONEZONE_IA' WHEN 3 THEN 'GLACIER' WHEN 4 THEN 'DEEP_ARCHIVE' WHEN 5 THEN 'INTELLIGENT_TIERING' END AS class FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.price_class(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("class"))


@query("x08_staged_types", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'compressed' ELSE 'binary' END AS content_type FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.staged_type(F.element_at(F.array(*map(F.lit, ["zstd", "gzip", "bzip2", "tar", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("content_type"))


@query("x33_fallback_prices", f"WITH {SQL_PRICES}, r AS (SELECT (CASE s_nationkey % 3 WHEN 0 THEN 'us-' WHEN 1 THEN 'eu-' ELSE 'ap-' END) || s_suppkey AS region, s_nationkey % 3 AS k FROM supplier) SELECT region, class, round(storage * CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 1.1::DOUBLE END, 9) AS storage, round(request / 10, 9) AS request FROM r, prices")
def _(spark, d):
    far = F.element_at(F.array(*map(F.lit, ["us-", "eu-", "ap-"])), (F.col("s_nationkey") % 3 + 1).cast("int"))
    rows = cost.fallback_prices(table(spark, d, "supplier").select(F.concat(far, F.col("s_suppkey").cast("string")).alias("region")), prices(spark))
    return rows.select("region", "class", F.round("storage", 9).alias("storage"), F.round("request", 9).alias("request"))
