"""Scalar rules on values that the small tables don't hold."""

import duckdb
from pyspark.sql import functions as F

from hawser.functions import scalars as S
from hawser.plans import batch


def test_storage_class_takes_pattern_and_retention_and_price_class_a_name(spark):
    rows = spark.createDataFrame([("", 0, "Archive"), ("archive", 366, "Outposts"), ("rare", 1, None), (None, 5, "General Purpose")], "pattern string, days int, name string")
    out = rows.select(S.storage_class(F.col("pattern"), F.col("days")), S.price_class(F.col("name"))).collect()
    assert [tuple(r) for r in out] == [("STANDARD", "GLACIER"), ("DEEP_ARCHIVE", None), ("GLACIER", None), ("INTELLIGENT_TIERING", "STANDARD")]


def test_fixed_rounds_as_printf(spark):
    values = [0.25, 0.75, 0.35, 1.45, 2.5, 3.5, 1.0005, 0.0005, 0.95, 9.95, 99.95, 1023.95, 1023.96875, 1e15 + 0.25, 0.0, -0.35, -2.25, 12345.678905, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", *(S.fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 3))).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(f"{r.v:.{d}f}" for d in (0, 1, 3)) for r in got]


def test_human_sizes_equal_the_sql(spark):
    """Ties of one decimal, and sizes beyond the SQL's largest unit."""
    sizes = [(2 * n + 1) << 18 for n in range(8)] + [(n << 30) + (1 << 28) for n in (1, 2, 999)] + [1075, 1076, 1792, 1023 * 1024 + 1000, (1 << 40) + (1 << 38), 1 << 52]
    totals = [999, 9949, 9950, 10500, 11500, 999_499, 9_950_000_000_000, 10_500_000_000_000, 1_407_100_281_125_780, 10**18]
    out = spark.createDataFrame([(s,) for s in sizes], "o_totalprice long").select(S.human_bytes(F.col("o_totalprice"), "TB")).collect()
    sql = "SELECT " + batch.ORACLES["x03_human_sizes"].split("SELECT id, ")[1].replace("FROM archives", "FROM (SELECT unnest($1) AS size)")
    assert [r[0] for r in out] == [r[0] for r in duckdb.execute(sql, [sizes]).fetchall()]
    out = spark.createDataFrame([(s,) for s in totals], "size long").select(S.human_bytes_si(F.col("size"), "TB"), S.human_bytes_si(F.col("size"))).collect()
    assert [r[0] for r in out] == [r[0] for r in duckdb.execute(f"SELECT {batch._SI} FROM (SELECT unnest($1) AS size)", [totals]).fetchall()]
    assert [r[1] for r in out][-2:] == ["1.4 PB", "1 EB"]
