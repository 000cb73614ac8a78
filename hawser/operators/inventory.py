"""Inventories of files: analysis, bin summaries, search, directory totals, set operations, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import human_bytes_si, is_listable, matches_globs


def analyze(files: DataFrame) -> DataFrame:
    """One row: largest_size, file_count, average_size (whole bytes), total_size; zeros for no files."""
    out = files.agg(F.max("size").alias("largest_size"), F.count("*").alias("file_count"), F.sum("size").alias("total_size"))
    average = F.when(F.col("file_count") > 0, F.expr("total_size div file_count")).otherwise(0)
    return out.select(F.coalesce("largest_size", F.lit(0)).cast("long").alias("largest_size"), "file_count", average.cast("long").alias("average_size"), F.coalesce("total_size", F.lit(0)).cast("long").alias("total_size"))


def without_ignored(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files whose base name matches none of the shell globs."""
    return files.where(~matches_globs(F.col("name"), globs))


def limit_per_root(files: DataFrame, limit: int) -> DataFrame:
    """The first `limit` files of each root, by destination (a global limit would starve later roots)."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy("destination"))
    return files.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def listable(files: DataFrame) -> DataFrame:
    return files.where(is_listable(F.col("name")))


def bin_summaries(packed: DataFrame, largest: str = "EB") -> DataFrame:
    """Per bin: count, size and its readable form in units up to `largest`."""
    out = packed.groupBy("suitcase_index").agg(F.count("*").alias("count"), F.sum("size").cast("long").alias("size"))
    return out.withColumn("human_size", human_bytes_si(F.col("size"), largest))


def bins_with_total(packed: DataFrame) -> DataFrame:
    """Per bin and, with a null bin, over all."""
    return packed.rollup("suitcase_index").agg(F.count("*").alias("count"), F.sum("size").cast("long").alias("size"))


def suitcase_name(index: Column, total: Column, prefix: str, user: str, fmt: str) -> Column:
    """`prefix-user-01-of-12.fmt`."""
    pad = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat(F.lit(f"{prefix}-{user}-"), pad(index), F.lit("-of-"), pad(total), F.lit(f".{fmt}"))


def search_files(files: DataFrame, pattern: str, toc: str | None = None, distinct: bool = True) -> DataFrame:
    """Files with `pattern` in the base name or, given the column `toc`, in an archive member's path; any case.

    A file that matches both ways comes once, or twice with distinct=False.
    """
    low = F.lit(pattern.lower())
    by_name = F.contains(F.lower(F.element_at(F.split("destination", "/"), -1)), low)
    if toc is None:
        return files.where(by_name)
    by_member = F.exists(F.coalesce(F.col(toc), F.array().cast("array<string>")), lambda m: F.contains(F.lower(m), low))
    return files.where(by_name | by_member) if distinct else files.where(by_name).unionAll(files.where(by_member))


def matching_directories(files: DataFrame, pattern: str) -> DataFrame:
    """Distinct (directory): destinations cut after the first place where `pattern` stands in their directory part."""
    low = F.lit(pattern.lower())
    folder = F.regexp_extract("destination", r"^(.*/)[^/]*$", 1)
    end = F.instr(F.lower("destination"), low) + F.length(low) - 1
    cut = F.regexp_replace(F.substring(F.col("destination"), F.lit(1), end), "/$", "")
    return files.where(F.contains(F.lower(folder), low)).select(cut.alias("directory")).distinct()


def search_directories(files: DataFrame, pattern: str, largest: str = "EB") -> DataFrame:
    """Per matching directory: total size (readable in units up to `largest`) and distinct bins of the files below its prefix.

    Membership is by bare prefix. Directories are found among the files' own prefixes: a file meets only directories
    of its own destination's lengths, so the join is on equality, not on a range.
    """
    directories = matching_directories(files, pattern)
    lengths = directories.select(F.length("directory").alias("n")).distinct()
    low = F.lit(pattern.lower())
    candidates = files.where(F.contains(F.lower(F.regexp_extract("destination", r"^(.*/)[^/]*$", 1)), low))
    cut = candidates.join(F.broadcast(lengths), F.length("destination") >= F.col("n")).select(  # at most as many lengths as a path has characters
        F.substring(F.col("destination"), F.lit(1), F.col("n")).alias("directory"), "size", "suitcase_index"
    )
    out = cut.join(directories, "directory").groupBy("directory").agg(F.sum("size").cast("long").alias("total_size"), F.countDistinct("suitcase_index").alias("suitcases"))
    return out.withColumn("total_size_hr", human_bytes_si(F.col("total_size"), largest))


def tree(files: DataFrame) -> DataFrame:
    """Every directory that holds files, at any depth: files and bytes below it."""
    parts = F.split("destination", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("directory"), "size")
    return below.groupBy("directory").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("size"))


def missing_members(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected (suitcase_index, destination) that the archives' tables of contents lack."""
    return expected.join(present, ["suitcase_index", "destination"], "left_anti")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key: the names of fields that differ between two states; a missing side differs in all."""
    left, right = old.select(F.col(key), *(F.col(f).alias(f"_o_{f}") for f in fields)), new.select(F.col(key), *(F.col(f).alias(f"_n_{f}") for f in fields))
    names = F.array_compact(F.array(*(F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), F.lit(f)) for f in fields)))
    return left.join(right, key, "full").select(key, F.array_join(names, ",").alias("changed")).where("changed <> ''")


def merged_metadata(roots: DataFrame) -> DataFrame:
    """(path, content) over roots (root_no, path, content): the latest root wins a path."""
    return roots.groupBy("path").agg(F.max_by("content", "root_no").alias("content"))
