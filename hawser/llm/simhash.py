"""SimHash near-duplicates found by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a fixed list of reference fingerprints (pivots). Two
fingerprints within `most` bits differ by at most `most` in every coordinate of that table. The pivots are the zero
word, masks of two neighbouring bits, and pseudo-random words. The first 33 coordinates give the bit count of each
two-bit cell, and a differing bit changes one cell only; so when the cells are dealt into GROUPS groups, any linked
pair agrees in all coordinates of at least GROUPS - most groups, and joining on each choice of that many groups meets
every linked pair. Pairs that meet are discarded by their largest coordinate difference; survivors are verified.

Where more fingerprints than CROWD share a key (one text edited thousands of times), pairs are not formed at all:
each such fingerprint stands for the 65 words within one bit of it, and fingerprints are within two bits exactly
when they share such a word, so linking each word's fingerprints to their smallest is exact and linear.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, text_or_empty
from .components import connected_components

WORDS_PER_SHINGLE = 3
SEED = 42
MOST_BITS = 2
GROUPS = 5
CROWD = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, k: int = WORDS_PER_SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the hashes of the word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = [hash_of(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-k].tolist()]
        hashes = [hash_of(line[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts: bounded memory for the bits
        set_in += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a (signed) long; null texts count as empty."""

    @F.pandas_udf(T.LongType())
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))

    return docs.select("doc_id", signed(text_or_empty()).alias("fp"))


def pivots(n_random: int = 15) -> list[int]:
    rng = random.Random(SEED)
    return [0, *(3 << (2 * i) for i in range(32)), *(rng.getrandbits(64) for _ in range(n_random))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(nodes: DataFrame, references: list[int]) -> DataFrame:
    """`nodes` (fp, ...) with `d`: the distances of fp to each reference."""
    return nodes.withColumn("d", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in references)))


def keyed(table_: DataFrame, groups: int, most: int) -> DataFrame:
    """A row per choice of groups: its number and the packed cell counts, taken from the distances."""

    def cell(i: int):  # bits of fp in cell i, 0..2, from the distances to the zero word and to the cell's mask
        return ((F.col("d")[0] + 2 - F.col("d")[i + 1]) / 2).cast("long")

    packed = [sum((cell(i) * (3**j) for j, i in enumerate(range(g, 32, groups))), F.lit(0).cast("long")) for g in range(groups)]
    grouped = table_.select("fp", "d", F.array(*packed).alias("g"))
    choices = list(itertools.combinations(range(groups), groups - most))
    keys = F.array(*(F.struct(F.lit(n).alias("choice"), F.xxhash64(F.lit(n), *(F.col("g")[i] for i in choice)).alias("key")) for n, choice in enumerate(choices)))
    return grouped.select("fp", "d", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp", "d")


def links(nodes: DataFrame, most: int = MOST_BITS, groups: int = GROUPS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of `nodes` (fp) at `most` or fewer differing bits, enough to connect
    all that are linked: every link outside crowds, and for crowds the links to a smallest member.
    """
    if most != 2:
        raise ValueError("crowds are linked through words at one bit, which is exact for two differing bits")
    references = pivots()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key. Pairs of a key's fingerprints that survive; crowds as (fp, null) rows."""
        held_fp, held_d, key, crowded = [], [], None, False
        a, b = [], []

        def close():
            if crowded or len(held_fp) < 2:
                return
            fp, d = np.array(held_fp, np.int64), np.array(held_d, np.int8)
            i, j = np.triu_indices(len(fp), 1)
            near = np.abs(d[i] - d[j]).max(axis=1) <= most  # largest coordinate difference
            i, j = i[near], j[near]
            true = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most
            a.extend(fp[i[true]].tolist())
            b.extend(fp[j[true]].tolist())

        for batch in batches:
            for choice, k, fp, d in zip(batch["choice"], batch["key"], batch["fp"], batch["d"], strict=True):
                if key != (choice, k):
                    close()
                    key, held_fp, held_d, crowded = (choice, k), [], [], False
                if crowded:
                    a.append(fp)
                    b.append(None)
                    continue
                held_fp.append(fp)
                held_d.append(d)
                if len(held_fp) > crowd:
                    a.extend(held_fp)
                    b.extend([None] * len(held_fp))
                    crowded = True
            yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})
            a, b = [], []
        close()
        yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})

    rows = keyed(pivot_table(nodes.select("fp"), references), groups, most)
    # a key with one fingerprint meets nothing: such rows go before the larger shuffle
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    rows = rows.join(shared, "key", "left_semi")
    met = cut(rows.repartition("key", "choice").sortWithinPartitions("choice", "key").select("choice", "key", "fp", "d").mapInPandas(meet, "a long, b long").distinct())
    crowds = met.where("b is null").select(F.col("a").alias("fp"))
    near = crowds.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("word"))
    # at most 65 fingerprints lie within one bit of a word
    starred = near.select(F.min("fp").over(Window.partitionBy("word")).alias("a"), F.col("fp").alias("b"))
    return met.where("b is not null").union(starred.where("a <> b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links of two or fewer bits, itself included.

    Exact copies share a fingerprint and are one node. Rows repeat as in `docs`; a null doc_id never names a
    component unless all ids of it are null. Texts without words have the fingerprint zero and are linked like others.
    """
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = cut(nodes)
    reached = connected_components(links(nodes))
    named = reached.join(nodes, reached["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    merged = reached.join(named, "component").select(F.col("node").alias("fp"), F.col("component_id").alias("merged_id"))
    by_fp = nodes.join(merged, "fp", "left").select("fp", F.coalesce("merged_id", "least").alias("component_id"))
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the smallest doc_id (one row, if it repeats).

    Rows without doc_id can't be told apart and are kept.
    """
    own = docs.columns
    kept = near_duplicates(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
    # the join leaves rows of a doc_id together, so that dropping repeated ones needs no second shuffle
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*own).union(docs.where("doc_id is null"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
