"""Choice of regions and prefixes, sticky sessions, quorums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, priority_factor
from .folds import fold


def available(regions: DataFrame, most_used: float | None = None) -> DataFrame:
    out = regions.where(F.col("status").isin("healthy", "degraded"))
    return out if most_used is None else out.where(F.col("used") < most_used)


def alternatives(regions: DataFrame, excluded: str) -> DataFrame:
    return regions.where((F.col("status") == "healthy") & (F.col("name") != excluded))


def ranked(regions: DataFrame, metrics: DataFrame | None, strategy: str) -> DataFrame:
    """`regions` (a dimension of a few rows) with rank: by latency (missing last, then priority), weight or priority."""
    if strategy == "latency":
        joined = regions.join(F.broadcast(metrics), "name", "left")
        order = [F.asc_nulls_last("latency_ms"), "priority"]
    else:
        joined, order = regions, [F.desc("weight"), "priority"] if strategy == "weight" else ["priority"]
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def select_regions(regions: DataFrame, preferred: str, count: int) -> DataFrame:
    """The preferred region, if healthy, then the best others by priority: `count` in all, none twice."""
    first = regions.where((F.col("name") == preferred) & (F.col("status") == "healthy")).withColumn("_first", F.lit(0))
    rest = available(regions).join(first.select("name"), "name", "left_anti").withColumn("_first", F.lit(1))
    order = Window.orderBy("_first", "priority")
    both = first.unionByName(rest).withColumn("rank", F.row_number().over(order).cast("long"))
    return both.where(F.col("rank") <= count).select("name", "rank")


def route(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """Each request's region: its preferred one where that is healthy, else the available one with least priority.

    Regions are a dimension of a few rows, broadcast; requests stay where they are.
    """
    best = available(regions).agg(F.min_by("name", "priority").alias("_best"))
    liked = regions.where("status = 'healthy'").select(F.col("name").alias("preferred"), F.lit(True).alias("_ok"))
    out = requests.join(F.broadcast(liked), "preferred", "left").join(F.broadcast(best))
    return out.withColumn("region", F.when(F.col("_ok"), F.col("preferred")).otherwise(F.col("_best"))).drop("_ok", "_best")


def sticky(requests: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """Region of the session that each request (key, ts, id, region) falls into, and when that session began: a session
    takes the region of its first request and lives `ttl_seconds` from it, however often it is used.
    """

    def step(state, row):
        if state is None or (row.ts - state[0]).total_seconds() > ttl_seconds:
            state = (row.ts, row.region)
        return state, [(row.id, *state)]

    rows = requests.select(key, "ts", "id", "region")
    kinds = dict(rows.dtypes)
    return fold(rows, key, ["ts", "id"], lambda: None, step, lambda s: [], f"{key} {kinds[key]}, id {kinds['id']}, start {kinds['ts']}, region string")


def quorum(writes: DataFrame, key: str, degraded: bool = False) -> DataFrame:
    """Per request of replicated writes (ok): regions, successes and whether a majority, (n + 1) div 2, was reached."""
    out = writes.groupBy(key).agg(F.count("*").alias("regions"), F.count_if("ok").alias("successes"))
    need = F.lit(1).cast("long") if degraded else F.expr("(regions + 1) div 2")
    return out.withColumn("accepted", F.col("successes") >= need)


def prefix_scores(prefixes: DataFrame, global_window: int = 64, bandwidth: float = 100.0) -> DataFrame:
    """Five-factor score of prefixes (window, throughput, latency_ms, error_rate, queue, capacity)."""
    c = F.col
    score = (
        c("window") / F.lit(float(global_window)) * 0.3 + c("throughput") / F.lit(bandwidth) * 0.25 + (1.0 / (1.0 + c("latency_ms") / 100.0)) * 0.2
        + (1.0 - c("error_rate")) * 0.15 + (1.0 - c("queue") / (c("capacity") + 1)) * 0.1
    )
    return prefixes.withColumn("score", score)


def best_prefixes(prefixes: DataFrame) -> DataFrame:
    """One row: the prefix with the best score, the fairest share and the lowest latency with room in its queue."""
    p = prefix_scores(prefixes)
    load = F.col("utilisation") + F.when(F.col("capacity") > 0, F.try_divide(F.col("queue"), F.col("capacity"))).otherwise(0.0)
    room = F.col("queue") < F.floor(F.col("capacity") * 0.8)
    return p.agg(
        F.max_by("prefix", F.struct("score", (-F.col("prefix")).alias("p"))).alias("best_score"), F.min_by("prefix", F.struct(load.alias("load"), "prefix")).alias("fair_share"),
        F.min_by(F.when(room, F.col("prefix")), F.when(room, F.struct("latency_ms", "prefix"))).alias("lowest_latency"),
    )


def adjusted_windows(prefixes: DataFrame, most: int = 64) -> DataFrame:
    """Congestion window after one round: x 0.8 over 5 % errors, x 1.1 under 1 % with room; whole, 1 to `most`."""
    c = F.col
    window = ladder(
        [(c("error_rate") > 0.05, F.greatest((c("window") * 0.8).cast("long"), F.lit(1))), ((c("error_rate") < 0.01) & (c("utilisation") < 0.8), F.least((c("window") * 1.1).cast("long"), F.lit(most)))],
        c("window").cast("long"),
    )
    return prefixes.withColumn("window", window)


def balance(prefixes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row: balance efficiency, and whether the spread of utilisation asks for rebalancing."""
    u = F.col("utilisation")
    out = prefixes.agg(F.count("*").alias("prefixes"), (1.0 / (1.0 + F.var_pop(u))).alias("efficiency"), F.try_divide(F.stddev_pop(u), F.avg(u)).alias("variation"))
    return out.withColumn("rebalance", (F.col("prefixes") >= 2) & F.coalesce(F.col("variation") > threshold, F.lit(False)))


def rebalanced(prefixes: DataFrame, total: float) -> DataFrame:
    """Bandwidth of each prefix: an even share, by priority, with up to a fifth more for utilisation."""
    share = F.lit(total) / F.count("*").over(Window.partitionBy())
    return prefixes.withColumn("allocated", share * priority_factor(F.col("priority")) * (1 + F.col("utilisation") * 0.2))
