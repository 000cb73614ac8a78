"""Storage cost, recommendations and lifecycle savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GIB, ladder
from ..model import PRICES, TRANSFER_PER_GB


def transfer_cost(gb: Column) -> Column:
    """The first GB is free."""
    return F.greatest(gb - 1.0, F.lit(0.0)) * TRANSFER_PER_GB


def fallback_prices(regions: DataFrame, prices: DataFrame) -> DataFrame:
    """region, class, storage, request of every region and class where no price list is at hand: a tenth more for storage in eu- and ap- regions.

    A list of a few classes is paired with each region on purpose; null regions get the plain prices.
    """
    far = F.coalesce(F.col("region").startswith("eu-") | F.col("region").startswith("ap-"), F.lit(False))
    listed = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(s).alias("storage"), F.lit(r / 10).alias("request")) for c, s, r in ((p["class"], p["storage"], p["request"]) for p in prices.collect())))
    rows = regions.select("region", F.explode(listed).alias("p"))
    return rows.select("region", "p.class", (F.col("p.storage") * F.when(far, 1.1).otherwise(1.0)).alias("storage"), "p.request")


def cost_matrix(archives: DataFrame, prices: DataFrame) -> DataFrame:
    """Per storage class: what storing, sending and requesting all archives costs. Aggregated first, then priced."""
    total = archives.agg((F.coalesce(F.sum("size"), F.lit(0)) / F.lit(float(GIB))).alias("gb"), F.count("*").alias("n"))
    priced = total.join(F.broadcast(prices))  # one row with the classes of the price list
    return priced.select("class", (F.col("gb") * F.col("storage")).alias("storage_usd"), transfer_cost(F.col("gb")).alias("transfer_usd"), (F.col("n") / 1000.0 * F.col("request")).alias("request_usd"))


def estimate(archives: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of totals: the sums over all classes (alternatives to each other), and monthly cost both as the minimum
    of the four main classes and as the true minimum over all."""
    m = cost_matrix(archives, prices)
    main = F.col("class").isin("STANDARD", "STANDARD_IA", "GLACIER", "DEEP_ARCHIVE")
    out = m.agg(
        F.sum("storage_usd").alias("storage_total"), F.sum("transfer_usd").alias("transfer_total"), F.sum("request_usd").alias("request_total"),
        F.sum(F.when(F.col("class") == "STANDARD", F.col("transfer_usd") + F.col("request_usd"))).alias("upload_usd"),
        F.min(F.when(main, F.col("storage_usd"))).alias("monthly_usd"), F.min("storage_usd").alias("least_monthly_usd"),
    )
    return out.withColumn("annual_usd", F.col("monthly_usd") * 12)


def recommendations(archives: DataFrame) -> DataFrame:
    """kind, subject (an archive's key or null), savings, confidence, impact."""
    gb = F.col("size") / F.lit(float(GIB))
    saved = gb * (0.023 - 0.00099)
    large = archives.where((F.col("size") > GIB) & (F.col("pattern") == "archive") & (saved > 1.0))
    none = F.lit(None).cast("string")
    deep = large.select(F.lit("deep_archive").alias("kind"), F.col("key").alias("subject"), saved.alias("savings"), F.lit(0.9).alias("confidence"), F.lit("high").alias("impact"))
    whole = archives.agg((F.sum("size") / F.lit(float(GIB))).alias("gb"), F.avg(F.coalesce("pattern", F.lit("")).isin("", "unknown").cast("double")).alias("unknown"), F.count_if(F.col("retention_days") > 365).alias("long"))
    tiering = whole.where("gb > 10 and unknown > 0.5").select(F.lit("intelligent_tiering"), none, F.col("gb") * 0.005, F.lit(0.7), F.lit("medium"))
    lifecycle = whole.where("long > 0").select(F.lit("lifecycle"), none, F.col("gb") * 0.01, F.lit(0.8), F.lit("high"))
    return deep.unionAll(tiering).unionAll(lifecycle)


def class_price(storage_class: Column) -> Column:
    return ladder([(storage_class == c, p) for c, p, _ in PRICES], PRICES[0][1])


def lifecycle_savings(templates: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per template and size (name, gb): monthly cost now and after the last transition, savings a year and percent.

    Templates are a short list, so each size meets each; percent is null for nothing stored.
    """
    joined = sizes.join(F.broadcast(templates))
    current = F.col("gb") * PRICES[0][1]
    last = F.try_element_at("transitions", F.lit(-1))["class"]
    after = F.when(last.isNull(), current).otherwise(F.col("gb") * class_price(last))
    return joined.select("name", "id", current.alias("current_usd"), after.alias("optimised_usd"), ((current - after) * 12).alias("annual_savings"), (F.try_divide(current - after, current) * 100).alias("percent"))


def custom_rules(patterns: DataFrame) -> DataFrame:
    """One rule per (prefix, frequency, retention_days): transitions by frequency, expiry by retention; ids by prefix.

    Ids come from the rank within the prefix's own hash bucket, so that no task numbers all prefixes.
    """
    step = lambda d, c: F.struct(F.lit(d).alias("days"), F.lit(c).alias("class"))
    steps = ladder(
        [
            (F.col("frequency") == "frequent", F.array(step(90, "STANDARD_IA"), step(365, "GLACIER"))),
            (F.col("frequency") == "infrequent", F.array(step(30, "STANDARD_IA"), step(90, "GLACIER"), step(365, "DEEP_ARCHIVE"))),
            (F.col("frequency") == "archive", F.array(step(0, "GLACIER"), step(90, "DEEP_ARCHIVE"))),
        ],
        F.array(step(0, "INTELLIGENT_TIERING")),
    )
    return patterns.select("prefix", F.concat(F.lit("custom-"), F.col("prefix")).alias("id"), steps.alias("transitions"), F.when(F.col("retention_days") > 0, F.col("retention_days")).alias("expiration"))


def rule_problem(transitions: Column) -> Column:
    """What is wrong with a rule's transitions, or null."""
    days = F.transform(transitions, lambda t: t["days"])
    falling = F.exists(F.sequence(F.lit(1), F.greatest(F.size(days) - 1, F.lit(1))), lambda i: F.coalesce(F.get(days, i) <= F.get(days, i - 1), F.lit(False)))
    known = [c for c, _, _ in PRICES[1:]]
    odd = F.exists(transitions, lambda t: ~t["class"].isin(known))
    return F.when(falling, "transitions must be in chronological order").when(odd, "invalid storage class")
