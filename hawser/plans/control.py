"""Queries over decisions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import SQL_ARCHIVES, SQL_REGIONS, SQL_SAMPLES, archives, regions, samples, table
from ..operators import content, decisions, history, transfer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def choose(column, *values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


@query("t12_recommendations", """WITH r AS (SELECT p_partkey, ['underutilization','congestion','poor_efficiency','network_degradation',NULL][p_partkey % 5 + 1] AS reason, p_size * 2 AS available, p_size % 9 AS c, p_size AS m FROM part)
  SELECT p_partkey, CAST(CASE reason WHEN 'underutilization' THEN least(c + 2, 8) WHEN 'congestion' THEN greatest(c - 1, 1) WHEN 'poor_efficiency' THEN greatest(c, 1) ELSE 2 END AS BIGINT) AS to_concurrency,
  CAST(CASE reason WHEN 'underutilization' THEN greatest(least(m + 10, 100), 5) WHEN 'congestion' THEN greatest(m - 5, 5) WHEN 'poor_efficiency' THEN greatest(m, 5) ELSE 10 END AS BIGINT) AS to_chunk_mb,
  CASE WHEN reason = 'underutilization' AND available > 50 THEN 'zstd-fast' WHEN reason IN ('congestion', 'network_degradation') THEN 'zstd-high' ELSE 'zstd' END AS to_codec,
  CAST(CASE reason WHEN 'underutilization' THEN 128 WHEN 'congestion' THEN 32 WHEN 'poor_efficiency' THEN 64 ELSE 16 END AS BIGINT) AS "window", CASE WHEN reason IN ('congestion', 'network_degradation') THEN 'cubic' ELSE 'bbr' END AS algorithm FROM r WHERE reason IS NOT NULL""")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", choose(F.col("p_partkey"), "underutilization", "congestion", "poor_efficiency", "network_degradation", None).alias("reason"), (F.col("p_size") * 2).alias("available"), (F.col("p_size") % 9).alias("concurrency"), F.col("p_size").alias("chunk_mb"))
    return decisions.recommendations(rows).select("p_partkey", "to_concurrency", "to_chunk_mb", "to_codec", "window", "algorithm")


@query("t11_session_parameters", f"""WITH {SQL_SAMPLES}, r AS (SELECT *, ['poor_performance','declining_performance',NULL][sample_id % 3 + 1] AS reason, sample_id % 40 AS rem, bandwidth * (latency_ms / 1000.0::DOUBLE) AS p0 FROM samples),
  p AS (SELECT *, CASE WHEN rem > 0 AND rem < CAST(trunc(p0) AS BIGINT) THEN CAST(rem AS DOUBLE) ELSE p0 END AS p FROM r)
  SELECT sample_id, CAST(CASE WHEN reason = 'poor_performance' AND congestion < 0.3::DOUBLE THEN 5 WHEN reason = 'declining_performance' THEN 3 ELSE 4 END AS BIGINT) AS to_concurrency,
  CAST(CASE reason WHEN 'poor_performance' THEN greatest(least(CAST(trunc(p * (1.0::DOUBLE - congestion * 0.3::DOUBLE)) AS BIGINT), 100), 5) WHEN 'declining_performance' THEN 19 ELSE 24 END AS BIGINT) AS to_chunk_mb,
  CASE WHEN reason = 'poor_performance' AND bandwidth > 50 THEN 'zstd-fast' ELSE 'zstd' END AS to_codec, CAST(CASE WHEN reason = 'declining_performance' THEN 4 ELSE 3 END AS BIGINT) AS to_retries FROM p""")
def _(spark, d):
    rows = samples(spark, d).withColumns({"reason": choose(F.col("sample_id"), "poor_performance", "declining_performance", None), "remaining_mb": F.col("sample_id") % 40, "concurrency": F.lit(4), "chunk_mb": F.lit(24), "codec": F.lit("zstd"), "retries": F.lit(3)})
    return decisions.session_parameters(rows).select("sample_id", "to_concurrency", "to_chunk_mb", "to_codec", "to_retries")


@query("t05_chosen_prefixes", f"WITH {SQL_ARCHIVES}, b AS (SELECT max(s_suppkey) AS best, min(s_suppkey) AS low, max(s_suppkey) // 2 AS rising FROM supplier) SELECT id, CASE WHEN size > 1073741824 THEN rising WHEN id % 7200 < 3600 THEN low ELSE best END AS prefix FROM archives, b")
def _(spark, d):
    best = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("best_score"), F.min("s_suppkey").alias("lowest_latency"), F.expr("max(s_suppkey) div 2").alias("rising"))
    return decisions.chosen_prefix(archives(spark, d).select("id", "size", (F.col("id") % 7200).alias("deadline_s")), best, 0.8, "increasing").select("id", "prefix")


@query("p07_status_rows", f"WITH {SQL_ARCHIVES} SELECT id, CASE WHEN id % 3 = 0 THEN 'in_progress' WHEN id % 3 = 1 THEN 'complete' ELSE 'failed' END AS status, CAST(id % 201 // 2 AS BIGINT) AS percent_done, CAST(CASE WHEN id % 3 = 1 THEN size // 2 ELSE (size // 3) // 2 END AS BIGINT) AS transferred, CAST(CASE WHEN id % 3 = 1 THEN size // 2 ELSE size END AS BIGINT) AS size_bytes FROM archives")
def _(spark, d):
    rows = archives(spark, d).select("id", (F.col("id") % 3 > 0).alias("finished"), (F.col("id") % 3 == 1).alias("success"), (F.col("id") % 201).alias("percent"), F.expr("size div 3").alias("bytes"), F.col("size").alias("total"))
    return decisions.status_rows(rows).select("id", "status", "percent_done", "transferred", "size_bytes")


@query("k07_object_metadata", f"WITH {SQL_ARCHIVES} SELECT id, concat_ws(',', CASE WHEN pattern <> '' THEN concat('access-pattern=', pattern) END, concat('original-size=', size), concat('owner=', owner), CASE WHEN retention_days > 0 THEN concat('retention-days=', retention_days) END) AS metadata_text FROM archives")
def _(spark, d):
    rows = archives(spark, d).withColumn("metadata", F.create_map(F.lit("owner"), F.col("owner").cast("string"), F.lit("original-size"), F.lit("overwritten")))
    return decisions.object_metadata(rows).select("id", "metadata_text")


@query("k21_rule_documents", """SELECT p_partkey, concat('{', CASE WHEN p_size % 3 > 0 THEN concat('"Expiration":{"Days":', p_size % 3, '},') ELSE '' END,
  CASE p_partkey % 4 WHEN 0 THEN '"Filter":{"Prefix":"a/"},' WHEN 1 THEN '"Filter":{"Tag":{"Key":"k","Value":"v"}},' WHEN 2 THEN '"Filter":{"And":{"Prefix":"a/","Tags":[{"Key":"k","Value":"v"}]}},' ELSE '' END, '"Transitions":[{"Days":', p_size, ',"StorageClass":"GLACIER"}]}') AS document FROM part""")
def _(spark, d):
    k = F.col("p_partkey") % 4
    tags = F.when(k.isin(1, 2), F.create_map(F.lit("k"), F.lit("v"))).otherwise(F.create_map().cast("map<string,string>"))
    doc = decisions.rule_document(F.when(k.isin(0, 2), "a/").otherwise(""), tags, F.array(F.struct(F.col("p_size").alias("days"), F.lit("GLACIER").alias("class"))), F.col("p_size") % 3)
    return table(spark, d, "part").select("p_partkey", doc.alias("document"))


@query("f17_in_failover", f"WITH {SQL_REGIONS} SELECT name FROM regions WHERE name IN (SELECT concat('NATION_', user_id % 40) FROM events WHERE event_type = 'error' AND event_id % 50 = 0)")
def _(spark, d):
    ops = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("NATION_"), (F.col("user_id") % 40).cast("string")).alias("from_region"), F.when(F.col("event_id") % 50 == 0, "in_progress").otherwise("done").alias("status"))
    return decisions.in_progress(regions(spark, d), ops).select("name")


@query("o06_best_boundaries", "WITH c AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_discount * 0.6::DOUBLE + l_tax * 0.4::DOUBLE AS s FROM lineitem) SELECT l_orderkey, l_partkey FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(s, 9) DESC, n, l_partkey DESC) = 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("n"), F.round(F.col("l_discount") * 0.6 + F.col("l_tax") * 0.4, 9).alias("s"), (F.col("l_linenumber") * 10_000_000 - F.col("l_partkey")).alias("o"))
    return decisions.best_of(rows, "l_orderkey", F.col("s"), "o").select("l_orderkey", "l_partkey")


@query("t23_latest_states", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    return decisions.latest_state(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("a38_status_maps", f"WITH {SQL_REGIONS} SELECT status, string_agg(concat(name, '=', priority), ',' ORDER BY name) AS states FROM regions GROUP BY 1")
def _(spark, d):
    m = regions(spark, d).groupBy("status").agg(F.map_from_entries(F.collect_list(F.struct("name", "priority"))).alias("m"))
    return m.select("status", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("states"))


@query("j11_best_chunks", "WITH o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount) - 1 AS i, l_quantity, l_discount FROM lineitem) SELECT l_orderkey, i AS chosen FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_quantity * l_discount, 6) DESC, i) = 1")
def _(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount")))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    sizes, gains = F.transform("r", lambda x: x["l_quantity"]), F.transform("r", lambda x: x["l_discount"])
    scored = F.transform(F.arrays_zip(sizes.alias("q"), gains.alias("g")), lambda z, i: F.struct(F.round(z["q"] * z["g"], 6).alias("s"), (-i).alias("i")))
    return per.select("l_orderkey", (-F.array_max(scored)["i"]).cast("long").alias("chosen"))


@query("x41_condition_keys", f"WITH {SQL_SAMPLES} SELECT sample_id, printf('boundary_%d_%d_network_%.1f_%.1f_%.3f', sample_id * 1000, 50, floor(bandwidth), latency_ms, congestion) AS key FROM samples")
def _(spark, d):
    c = F.col
    return samples(spark, d).select("sample_id", decisions.reliability_key(c("sample_id") * 1000, F.lit(0.5), F.floor("bandwidth").cast("double"), c("latency_ms"), c("congestion")).alias("key"))


@query("x36_statuses", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'complete' ELSE 'failed' END AS status, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS INTEGER) AS code FROM orders")
def _(spark, d):
    names = spark.createDataFrame([("O", "in_progress", 1), ("F", "complete", 2), ("P", "failed", 3)], "o_orderstatus string, status string, code int")
    return table(spark, d, "orders").join(F.broadcast(names), "o_orderstatus").select("o_orderkey", "status", "code")


@query("x37_decoded_credentials", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey * 60 AS BIGINT) AS expires FROM nation")
def _(spark, d):
    blob = F.base64(F.encode(F.to_json(F.struct(F.col("n_name").alias("name"), (F.col("n_regionkey") * 60).alias("expires"))), "UTF-8"))
    decoded = F.from_json(F.decode(F.unbase64(blob), "UTF-8"), "name string, expires bigint")
    return table(spark, d, "nation").select("n_nationkey", decoded.alias("c")).select("n_nationkey", "c.name", "c.expires")


@query("x42_overheads", f"WITH {SQL_SAMPLES} SELECT link, least(count(*) * 1.0::DOUBLE, 10.0::DOUBLE) AS overhead FROM samples GROUP BY 1")
def _(spark, d):
    return samples(spark, d).groupBy("link").agg(decisions.overhead_percent(F.count("*")).alias("overhead"))


@query("x44_session_concurrency", f"WITH {SQL_ARCHIVES} SELECT id, CAST(CASE WHEN id % 4 = 0 THEN greatest(1, id % 9 - 1) ELSE id % 9 END AS BIGINT) AS concurrency FROM archives")
def _(spark, d):
    n = F.col("id") % 9
    return archives(spark, d).select("id", F.when(F.col("id") % 4 != 0, n).otherwise(F.greatest(F.lit(1), n - 1)).cast("long").alias("concurrency"))


@query("x43_small_ratios", f"WITH {SQL_ARCHIVES} SELECT id, round(least(owner / 1048576.0::DOUBLE, 1.0::DOUBLE), 9) AS quality, CASE WHEN owner % 5 = 0 THEN 1.0::DOUBLE ELSE round(size / CAST(owner % 5 AS DOUBLE), 6) END AS ratio FROM archives")
def _(spark, d):
    original = F.col("owner") % 5
    return archives(spark, d).select("id", F.round(F.least(F.col("owner") / float(S.MIB), F.lit(1.0)), 9).alias("quality"), F.coalesce(F.round(F.try_divide(F.col("size"), original), 6), F.lit(1.0)).alias("ratio"))


@query("t17_failover_routes", f"WITH {SQL_ARCHIVES}, {SQL_REGIONS}, q AS (SELECT id, concat('NATION_', id % 25) AS preferred, CASE WHEN id % 3 = 0 THEN [concat('NATION_', id % 25), 'NATION_1'] ELSE [] END AS fails FROM archives), h AS (SELECT * FROM regions WHERE status = 'healthy') SELECT id, CASE WHEN preferred IN (SELECT name FROM h) AND NOT list_contains(fails, preferred) THEN preferred ELSE (SELECT name FROM h WHERE NOT list_contains(fails, h.name) ORDER BY priority LIMIT 1) END AS region FROM q")
def _(spark, d):
    liked = F.concat(F.lit("NATION_"), (F.col("id") % 25).cast("string"))
    requests = archives(spark, d).select("id", liked.alias("preferred"), F.when(F.col("id") % 3 == 0, F.array(liked, F.lit("NATION_1"))).otherwise(F.array().cast("array<string>")).alias("fails"))
    return decisions.failover_routes(requests, regions(spark, d)).select("id", "region")


@query("d11_boundary_pipeline")
def _(spark, d):
    """Windows of each document, their entropy and type, the predicted ratio, and the best window by composite score."""
    w = content.windows(table(spark, d, "documents"), "doc_id", width=4096).withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("window").cast("string")))
    measured = content.byte_entropy(w, "id", "content").join(w.select("id", "doc_id", "window", content.classify(F.col("content")).alias("kind")), "id")
    ratio = content.predicted_ratio(F.col("entropy"), F.col("kind"), F.lit(0.3), F.lit(0.0))
    score = content.composite_score(ratio, F.lit(0.5), F.col("bytes"), 4096.0)
    scored = measured.select("doc_id", "window", "kind", F.round("entropy", 6).alias("entropy"), F.round(score, 6).alias("score"))
    return decisions.best_of(scored, "doc_id", F.col("score"), "window")


@query("t20_session_efficiency", f"WITH {SQL_SAMPLES} SELECT link, round(least(avg(bandwidth) / 50.0::DOUBLE + 0.05::DOUBLE * count(*) FILTER (NOT success), 1.0::DOUBLE), 6) AS efficiency FROM samples GROUP BY 1")
def _(spark, d):
    g = samples(spark, d).groupBy("link").agg(F.least(F.avg("bandwidth") / 50.0 + 0.05 * F.count_if(~F.col("success")), F.lit(1.0)).alias("efficiency"))
    return g.select("link", F.round("efficiency", 6).alias("efficiency"))


@query("t13_condition_pipeline", f"WITH {SQL_SAMPLES}, a AS (SELECT sample_id, link, avg(bandwidth) OVER w AS b, avg(latency_ms) OVER w AS l FROM samples WINDOW w AS (PARTITION BY link ORDER BY ts, sample_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT link, count(*) FILTER (b < 10) AS poor, count(*) FILTER (l > 100) AS slow FROM a GROUP BY 1")
def _(spark, d):
    m = transfer.moving_conditions(samples(spark, d))
    return m.groupBy("link").agg(F.count_if(F.col("est_bandwidth") < 10).alias("poor"), F.count_if(F.col("est_latency") > 100).alias("slow"))


@query("t10_session_progress", f"WITH {SQL_SAMPLES}, s AS (SELECT link, sample_id, sum(bandwidth) OVER (PARTITION BY link ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS done, sum(bandwidth) OVER (PARTITION BY link) AS total FROM samples) SELECT sample_id, round(done * 100.0::DOUBLE / total, 4) AS percent FROM s")
def _(spark, d):
    from pyspark.sql import Window

    per, so_far = Window.partitionBy("link"), Window.partitionBy("link").orderBy("ts", "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples(spark, d).select("sample_id", F.sum("bandwidth").over(so_far).alias("done"), F.sum("bandwidth").over(per).alias("total"), F.lit(1.0).alias("elapsed"))
    return history.progress(rows).select("sample_id", F.round("percent", 4).alias("percent"))
