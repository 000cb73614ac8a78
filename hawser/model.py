"""The driver's tables in the roles that the operators work on, and the fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Storage price in USD a GB and month, and request price a thousand, by class.
PRICES = [
    ("STANDARD", 0.023, 0.005), ("STANDARD_IA", 0.0125, 0.01), ("ONEZONE_IA", 0.01, 0.01),
    ("INTELLIGENT_TIERING", 0.0225, 0.005), ("GLACIER", 0.004, 0.03), ("DEEP_ARCHIVE", 0.00099, 0.05),
]
TRANSFER_PER_GB = 0.09
# Lifecycle templates, each with its last rule's transitions (days, class) and expiry.
TEMPLATES = [
    ("archive-optimization", "archives/", [(30, "STANDARD_IA"), (90, "GLACIER"), (365, "DEEP_ARCHIVE")], None),
    ("intelligent-tiering", "archives/", [(0, "INTELLIGENT_TIERING")], None),
    ("compliance-retention", "archives/compliance/", [(30, "STANDARD_IA"), (90, "GLACIER"), (365, "DEEP_ARCHIVE")], 2555),
    ("fast-access", "archives/frequent/", [(90, "STANDARD_IA"), (365, "GLACIER")], None),
]

_EXT = [".txt", ".json", ".tar.gz", ".jpg", ".mp4", ".pdf", ".so", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "class string, storage double, request double")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "id string, prefix string, transitions array<struct<days:int,class:string>>, expiration int")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_id, root, destination, name, size (characters)."""
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("root"), F.concat_ws("/", "source", "lang", name).alias("destination"), name.alias("name"), F.col("n_chars").alias("size")
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as archives: id, key, size, pattern, retention_days, prefix_no, owner."""
    pattern = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "frequent").when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "P"), "rare")
        .when(F.col("o_orderpriority") == "2-HIGH", "infrequent").when(F.col("o_orderpriority") == "3-MEDIUM", "archive").when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise("")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("archives/"), F.col("o_orderkey").cast("string")).alias("key"), F.floor(F.col("o_totalprice") * 10000).cast("long").alias("size"),
        pattern.alias("pattern"), (F.col("o_custkey") % 500).alias("retention_days"), F.col("o_custkey").alias("owner"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as network samples of twelve links: sample_id, link, ts, bandwidth, latency_ms, congestion, loss, success."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"), (F.col("user_id") % 12).alias("link"), "ts", F.col("value").alias("bandwidth"),
        ((F.col("event_id") % 37) * 5 + 20).cast("double").alias("latency_ms"), ((F.col("event_id") % 11) / 10.0).cast("double").alias("congestion"),
        F.when(F.col("event_type") == "error", 0.02).otherwise(0.001).cast("double").alias("loss"), (F.col("event_type") != "error").alias("success"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as storage regions: name, priority, weight, status, used (percent of capacity)."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), key.cast("long").alias("priority"), (key * 7 % 10).cast("long").alias("weight"),
        F.when(key % 5 == 0, "degraded").when(key % 5 == 4, "offline").otherwise("healthy").alias("status"), (key * 13 % 100).cast("double").alias("used"),
    )


# The same roles in the oracle's SQL.
SQL_FILES = """files AS (SELECT doc_id AS file_id, source AS root,
  concat(source, '/', lang, '/Doc-', doc_id, ['.txt','.json','.tar.gz','.jpg','.mp4','.pdf','.so',''][doc_id % 8 + 1]) AS destination,
  concat('Doc-', doc_id, ['.txt','.json','.tar.gz','.jpg','.mp4','.pdf','.so',''][doc_id % 8 + 1]) AS name, n_chars AS size FROM documents)"""
SQL_ARCHIVES = """archives AS (SELECT o_orderkey AS id, concat('archives/', o_orderkey) AS key, CAST(floor(o_totalprice * 10000) AS BIGINT) AS size,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'frequent' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 'rare'
       WHEN o_orderpriority = '2-HIGH' THEN 'infrequent' WHEN o_orderpriority = '3-MEDIUM' THEN 'archive' WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE '' END AS pattern,
  o_custkey % 500 AS retention_days, o_custkey AS owner FROM orders)"""
SQL_SAMPLES = """samples AS (SELECT event_id AS sample_id, user_id % 12 AS link, ts, value AS bandwidth, CAST((event_id % 37) * 5 + 20 AS DOUBLE) AS latency_ms,
  CAST(event_id % 11 AS DOUBLE) / 10.0 AS congestion, CASE WHEN event_type = 'error' THEN 0.02::DOUBLE ELSE 0.001::DOUBLE END AS loss, event_type <> 'error' AS success FROM events)"""
SQL_REGIONS = """regions AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS priority, CAST(n_nationkey * 7 % 10 AS BIGINT) AS weight,
  CASE WHEN n_nationkey % 5 = 0 THEN 'degraded' WHEN n_nationkey % 5 = 4 THEN 'offline' ELSE 'healthy' END AS status, CAST(n_nationkey * 13 % 100 AS DOUBLE) AS used FROM nation)"""
SQL_PRICES = "prices(class, storage, request) AS (VALUES " + ", ".join(f"('{c}', {s}::DOUBLE, {r}::DOUBLE)" for c, s, r in PRICES) + ")"
