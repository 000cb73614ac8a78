"""Packing into bins and distribution over prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fnv1a_32


class BinTree:
    """Segment tree over open bins in order: the first bin with room, in logarithmic time."""

    def __init__(self, cap: int, size: int = 64):
        self.cap, self.size, self.used, self.most = cap, size, 0, [0] * (2 * size)

    def _set(self, i: int, room: int) -> None:
        i += self.size
        self.most[i] = room
        i >>= 1
        while i:
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])
            i >>= 1

    def place(self, size: int) -> int:
        if self.most[1] < size or not self.used:
            if self.used == self.size:
                rooms = self.most[self.size :]
                self.size *= 2
                self.most = [0] * (2 * self.size)
                self.most[self.size : self.size + len(rooms)] = rooms
                for i in range(self.size - 1, 0, -1):
                    self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])
            self._set(self.used, self.cap - size)
            self.used += 1
            return self.used - 1
        i = 1
        while i < self.size:
            i = 2 * i if self.most[2 * i] >= size else 2 * i + 1
        self._set(i - self.size, self.most[i] - size)
        return i - self.size


def oversize(files: DataFrame, cap: int) -> DataFrame:
    """Files that no bin can hold; packing asks for none."""
    return files.where(F.col("size") > cap)


def pack(files: DataFrame, cap: int, shard: Column | None = None, order: str = "destination") -> DataFrame:
    """`files` with suitcase_index from 1, by first-fit decreasing into bins of `cap`; ties by `order`.

    cap 0 puts all into one bin. Shards (all rows by default one) are packed apart from each other, in parallel, and
    their bins numbered within the shard; a shard is streamed sorted through one task, which holds its open bins only.
    A file over the cap raises.
    """
    if cap == 0:
        return files.withColumn("suitcase_index", F.lit(1).cast("long"))
    own = files.columns
    marked = files.withColumn("_shard", shard if shard is not None else F.lit(0))
    fits = F.when(F.col("size") > cap, F.raise_error(F.format_string("a file of %d bytes is too large for a suitcase", "size"))).otherwise(F.col("size"))
    ordered = marked.withColumn("size", fits).repartition("_shard").sortWithinPartitions("_shard", F.desc("size"), order)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, bins = None, None
        for batch in batches:
            index = []
            for of, size in zip(batch["_shard"], batch["size"], strict=True):
                if bins is None or of != shard:
                    shard, bins = of, BinTree(cap)
                index.append(bins.place(int(size)) + 1)
            yield batch.assign(suitcase_index=pd.Series(index, dtype="int64", index=batch.index))

    return ordered.mapInPandas(place, _ddl(ordered) + ", suitcase_index long").select(*own, "suitcase_index")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def round_robin(rows: DataFrame, n: int, order: str) -> DataFrame:
    """batch = position mod n, by `order`. Positions come from counts of ordered ranges, not from one sorted task."""
    return ordinal(rows, order).withColumn("batch", F.pmod(F.col("ordinal"), F.lit(n)).cast("long")).drop("ordinal")


def ordinal(rows: DataFrame, order: str) -> DataFrame:
    """`rows` with their position by `order` (unique), from 0: ranked within ranges, plus the ranges' counts before."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(order, [i / n for i in range(1, n)] if n > 1 else [0.5], 10_000).alias("c")).first()["c"]
    if not cuts:  # no rows
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(order)))
    rows = rows.withColumn("_range", bucket)
    counts = rows.groupBy("_range").count()
    before = counts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return ranked.join(F.broadcast(before), "_range").withColumn("ordinal", (F.col("_rank") - 1 + F.col("_before")).cast("long")).drop("_range", "_rank", "_before")


def by_hash(rows: DataFrame, n: int, key: str = "key") -> DataFrame:
    return rows.withColumn("batch", F.pmod(fnv1a_32(F.col(key)), F.lit(n)).cast("long"))


def least_loaded(rows: DataFrame, n: int, order: str, shard: Column) -> DataFrame:
    """batch of each row: the one with the smallest sum of sizes so far in its shard, lowest number on ties.

    The order of rows decides, so a shard is one sorted stream; shards run in parallel.
    """
    own = rows.columns
    ordered = rows.withColumn("_shard", shard).repartition("_shard").sortWithinPartitions("_shard", order)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        of, heap = object(), []
        for batch in batches:
            out = []
            for s, size in zip(batch["_shard"], batch["size"], strict=True):
                if s != of:
                    of, heap = s, [(0, i) for i in range(n)]
                load, i = heap[0]
                heapq.heapreplace(heap, (load + int(size), i))
                out.append(i)
            yield batch.assign(batch=pd.Series(out, dtype="int64", index=batch.index))

    return ordered.mapInPandas(place, _ddl(ordered) + ", batch long").select(*own, "batch")


def batch_priorities(batched: DataFrame) -> DataFrame:
    """Per batch: archives, bytes and the priority, which is whole MiB."""
    out = batched.groupBy("batch").agg(F.count("*").alias("archives"), F.sum("size").cast("long").alias("total_bytes"))
    return out.withColumn("priority", F.expr("total_bytes div 1048576"))


def hash_prefixes(spark, n: int) -> DataFrame:
    digit = lambda v: F.substring(F.lit("0123456789abcdef"), (F.pmod(v, F.lit(16)) + 1).cast("int"), F.lit(1))
    i = F.col("id")
    return spark.range(n).select(F.col("id").alias("batch"), F.concat(F.lit("archives/"), digit(i), digit(F.floor(i / 16)), F.lit("/")).alias("prefix"))


def sequential_prefixes(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("batch"), F.concat(F.lit("archives/batch-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("/")).alias("prefix"))


def date_prefixes(spark, n: int, start: str) -> DataFrame:
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(start).cast("timestamp_ntz"))
    return spark.range(n).select(F.col("id").alias("batch"), F.concat(F.lit("archives/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/batch-"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit("/")).alias("prefix"))


def even_chunks(sized: DataFrame, target: int) -> DataFrame:
    """Per row with size > 0: ceil(size / target) chunks of equal size, the last with the remainder."""
    n = F.ceil(F.col("size") / F.lit(float(target))).cast("long")
    chunk = F.expr("size div _n")
    rows = sized.where("size > 0").withColumn("_n", n).withColumn("_chunk", chunk).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("chunk") * F.col("_chunk")
    return rows.withColumn("start_offset", start).withColumn("end_offset", F.when(F.col("chunk") == F.col("_n") - 1, F.col("size")).otherwise(start + F.col("_chunk"))).drop("_n", "_chunk")


def member_chunks(members: DataFrame, target: int, shard: str = "root") -> DataFrame:
    """Chunks of consecutive archive members (offset, size; 512 header bytes each), cut before a span over 2 x target."""
    ordered = members.select(shard, "offset", "size").repartition(shard).sortWithinPartitions(shard, "offset")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, start, held, end = None, 0, 0, 0
        rows: list[tuple] = []
        for batch in batches:
            for s, offset, size in zip(batch[shard], batch["offset"], batch["size"], strict=True):
                if s != of:
                    if held:
                        rows.append((of, start, end))
                    of, start, held = s, 0, 0
                span = offset + size + 512 - start
                if held and span > 2 * target:
                    rows.append((of, start, offset))
                    start, held = offset, size + 512
                else:
                    held = span
                end = offset + size + 512
            yield pd.DataFrame(rows, columns=[shard, "start_offset", "end_offset"])
            rows = []
        if held:
            yield pd.DataFrame([(of, start, end)], columns=[shard, "start_offset", "end_offset"])

    return ordered.mapInPandas(cut, f"{shard} string, start_offset long, end_offset long")


def weighted_pick(requests: DataFrame, options: DataFrame, target: Column) -> DataFrame:
    """Each request's option by cumulative weight: `target` (a row's number) mod the sum falls into its range.

    Options (name, priority, weight) are a dimension table of a few rows; without weight, the first by priority.
    """
    order = Window.orderBy("priority")
    up_to = F.sum("weight").over(order)
    total = F.sum("weight").over(Window.partitionBy())
    ranges = options.select("name", (up_to - F.col("weight")).alias("_low"), up_to.alias("_high"), total.alias("_total"), F.row_number().over(order).alias("_nth"))
    requests = requests.withColumn("_target", target)
    inside = F.when(F.col("_total") > 0, (F.pmod("_target", "_total") >= F.col("_low")) & (F.pmod("_target", "_total") < F.col("_high"))).otherwise(F.col("_nth") == 1)
    return requests.join(F.broadcast(ranges), inside).drop("_target", "_low", "_high", "_total", "_nth")
