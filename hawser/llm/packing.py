"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so documents of one length are interchangeable: the packing is worked
out on the histogram of lengths (at most `capacity` rows, whatever the corpus), exactly as best fit decreasing would
place the documents one after another, and then handed to the documents by their rank within their length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty
from .token_count import SharedTokenizer, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Rows of one length that are ranked together, about; each length is salted into groups of this size.
ROWS_PER_RANK_GROUP = 1_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "length long, first_rank long, n long, first_bin long, per_bin long, first_offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..top: how many groups of open bins have each."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of an open bin that is `need` or more, in logarithmic time."""
        i = need + self.size
        while not self.count[i]:
            while i & 1:  # a right child: go up
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLACES: documents `first_rank` to `first_rank + n - 1` of a length fill `per_bin` to a bin from `first_bin`.

    `counts` maps a length (1..capacity) to how many documents have it. Each step puts as many documents of the
    current length as fit into the tightest open bins; equal bins are kept as one range.
    """
    tree, groups, places, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            groups[remaining].append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length} does not fit into {capacity}")
        need, rank = counts[length], 0
        while need:
            remaining = tree.tightest(length)
            if remaining is None:
                n = math.ceil(need / (capacity // length))
                put(capacity, bins, n)
                bins += n
                remaining = capacity
            first, n = groups[remaining].pop()
            tree.add(remaining, -1)
            per = remaining // length
            full = min(n, need // per)
            if full:
                places.append((length, rank, full * per, first, per, capacity - remaining))
                put(remaining - per * length, first, full)
                rank, need = rank + full * per, need - full * per
            if need and full < n:  # the last documents share one bin
                places.append((length, rank, need, first + full, need, capacity - remaining))
                put(remaining - need * length, first + full, 1)
                full, rank, need = full + 1, rank + need, 0
            put(remaining, first + full, n - full)
    return places


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of PIECES: each document's ids with the end id, cut into pieces only when longer than `capacity`.

    Of a longer document the first piece takes the odd rest, so that all others are full. A null text is an empty
    one: the end id alone.
    """
    shared = SharedTokenizer(docs.sparkSession, tokenizer)
    end = end_id.to_bytes(4, "little")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = shared.encoder().ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end
                n = len(ids) >> 2
                piece, start = 0, 0
                while start < n:
                    stop = start + ((n % capacity or capacity) if not start else capacity)
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    piece, start = piece + 1, stop
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(cut_up, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_group: int = ROWS_PER_RANK_GROUP) -> DataFrame:
    """`pieces` (rows with doc_id, piece and length) with sequence_id and offset, by best fit decreasing.

    Only the histogram of lengths comes to the driver. Ranks within a length are counted in salted groups and added
    up, so that a length which a third of all rows share is not ranked in one task; a length has as many groups as
    its rows need. Repeated rows are packed each for itself; an empty table packs into nothing.
    """
    spark, own = pieces.sparkSession, pieces.columns
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = best_fit_decreasing(counts, capacity)
    salts = F.array(*(F.lit(max(1, math.ceil(counts.get(n, 0) / rows_per_group))) for n in range(1, capacity + 1)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(salts, F.col("length").cast("int"))))
    in_group = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    ranked = salted.withColumn("_rank", F.row_number().over(in_group) - 1).join(bases, ["length", "_salt"])
    at = spark.createDataFrame(places, PLACES).withColumnRenamed("length", "_length")
    rank = F.col("_rank") + F.col("_base")
    nth = rank - F.col("first_rank")
    # some thousand places at most: their number is bound by the capacity, not by the documents
    placed = ranked.join(F.broadcast(at), (F.col("length") == F.col("_length")) & (rank >= F.col("first_rank")) & (rank < F.col("first_rank") + F.col("n")))
    return placed.select(
        *own,
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document with its place in a sequence; texts are tokenised once."""
    return pack(cut(token_pieces(docs, tokenizer, capacity, end_id)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
