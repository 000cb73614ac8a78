"""Order MinHash fingerprints of documents; DataFrame functions only.

A text is the sequence of its white-space separated words, and a k-mer is K neighbouring words (fewer words: all of
them). Each k-mer is numbered by its occurrence in the text, so that repeats count. A hash of (k-mer, occurrence)
deals the pairs to BINS sketches and orders them there; of each sketch the TUPLE smallest pairs are kept, put back
into text order, and hashed together. Swapped passages change the order and so the tuples: the share of equal sketches
falls with edit distance, not just with the words in common.

Everything happens on sorted arrays of 64-bit words that carry hash and position together. Occurrence numbers come
from the runs of equal hashes in sorted order, so the work of a text is n log n, with no quadratic step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

K = 5
TUPLE = 2
BIN_BITS = 5
BINS = 1 << BIN_BITS
#: Documents that lie in one window partition when each is given its successor, about.
ROWS_PER_BUCKET = 2048

_POSITION_BITS = 30
_POSITION = (1 << _POSITION_BITS) - 1
_ORDER_BITS = 64 - _POSITION_BITS - BIN_BITS
_ORDER = (1 << _ORDER_BITS) - 1


def _with_position(h: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftright(h, _POSITION_BITS), _POSITION_BITS).bitwiseOR(position.cast("long"))


def with_signature(rows: DataFrame, text: str, out: str, k: int = K, tuple_size: int = TUPLE) -> DataFrame:
    """`rows` with `out`: array<bigint>, one entry for each non-empty sketch (sketch number and tuple hash)."""
    keep = rows.columns
    n = F.size("_w")
    rows = rows.select(*keep, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
    rows = rows.select(*keep, F.when(n >= k, F.transform("_w", lambda w: F.xxhash64(w))).when(n > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # k-mers, with their positions in the lower bits
    size = F.size("_h")
    kmer = lambda i: F.xxhash64(*(F.col("_h")[i + j] for j in range(k)))
    rows = rows.select(
        *keep,
        F.sort_array(
            F.when(size >= k, F.transform(F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))), lambda i: _with_position(kmer(i), i)))
            .otherwise(F.transform("_h", lambda h, i: _with_position(h, i)))
        ).alias("_s"),
    )
    # where each run of equal k-mers begins; the occurrence number counts from there
    size = F.size("_s")
    of = lambda x: F.shiftright(x, _POSITION_BITS)
    begins = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i == 0) | (of(F.col("_s")[i]) != of(F.col("_s")[i - 1])))
    rows = rows.select(*keep, "_s", F.when(size > 0, begins).alias("_b"))
    counted = F.flatten(F.transform("_b", lambda b, j: F.sequence(F.lit(1), F.coalesce(F.get("_b", j + 1), F.size("_s")) - b)))
    rows = rows.select(*keep, "_s", F.when(F.size("_b") < F.size("_s"), counted).alias("_o"))
    dealt = lambda x, occurrence: _with_position(F.xxhash64(of(x), occurrence), x.bitwiseAND(_POSITION))
    rows = rows.select(
        *keep,
        F.sort_array(F.when(F.col("_o").isNull(), F.transform("_s", lambda x: dealt(x, F.lit(1)))).otherwise(F.transform("_s", lambda x, i: dealt(x, F.col("_o")[i])))).alias("_p"),
    )
    # the smallest of each sketch, then in text order
    sketch = lambda x: F.shiftright(x, 64 - BIN_BITS)
    chosen = F.filter("_p", lambda x, i: (i < tuple_size) | (sketch(x) != sketch(F.get("_p", i - tuple_size))))
    ordered = lambda x: (
        F.shiftleft(sketch(x), 64 - BIN_BITS).bitwiseOR(F.shiftleft(x.bitwiseAND(_POSITION), _ORDER_BITS)).bitwiseOR(F.shiftright(x, _POSITION_BITS).bitwiseAND(_ORDER))
    )
    rows = rows.select(*keep, F.sort_array(F.transform(chosen, ordered)).alias("_c"))
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_c") - 1, F.lit(0))), lambda i: (i == 0) | (sketch(F.col("_c")[i]) != sketch(F.get("_c", i - 1))))
    member = lambda i, j: F.when(sketch(F.get("_c", i + j)) == sketch(F.col("_c")[i]), F.get("_c", i + j).bitwiseAND(_ORDER))
    tuple_hash = lambda i: F.pmod(F.xxhash64(*(member(i, j) for j in range(tuple_size))), F.lit(1 << (32 - BIN_BITS)))
    number = lambda i: F.pmod(sketch(F.col("_c")[i]), F.lit(BINS))
    signed = F.transform(first, lambda i: F.shiftleft(number(i), 32 - BIN_BITS).bitwiseOR(tuple_hash(i)))
    return rows.select(*keep, F.when(F.size("_c") > 0, signed).otherwise(F.array().cast("array<bigint>")).alias(out))


def as_text(signature: str) -> Column:
    """Eight hexadecimal digits for each sketch; the empty string for a text without words."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal sketches among those that either text fills; 1 for two texts without words."""
    sketches = lambda s: F.transform(s, lambda x: F.shiftright(x, 32 - BIN_BITS))
    filled = F.size(F.array_union(sketches(F.col(a)), sketches(F.col(b))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.col(a), F.col(b))) / filled)


def _buckets(docs: DataFrame, rows_per_bucket: int) -> Column:
    """Number of the id range that a doc_id lies in, rising as ids fall; null ids come last.

    Ranges are of equal width. Where ids lie so unevenly that one such range would hold far too many rows, ranges
    between approximate quantiles are taken instead.
    """
    least, most, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if least is None:
        return F.lit(0).cast("long")
    width = max(1, math.ceil((most - least + 1) * rows_per_bucket / n))
    even = F.floor((F.lit(most) - F.col("doc_id")) / F.lit(width)).cast("long")
    last = (most - least) // width + 1
    largest = docs.groupBy(even.alias("b")).count().agg(F.max("count")).first()[0]
    if largest > 16 * rows_per_bucket:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / 1000 for i in range(1, 1000)], 100_000)).first()[0]
        cuts = sorted(set(cuts))
        even, last = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id"))).cast("long"), len(cuts) + 1
    return F.when(F.col("doc_id").isNotNull(), even).otherwise(F.lit(last).cast("long"))


def fingerprint_with_edits(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every row's fingerprint, its edited text's, and how alike they and the next row's are.

    The next document is the one after in descending doc_id (null ids last, ties by the text's hash), after the last
    the first. Rows are dealt once, by id range; the head of each range is also sent to the range before it, so a
    successor is always at hand. Null texts count as empty; a single row is its own successor.
    """
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    docs = docs.withColumn("_bucket", _buckets(docs, rows_per_bucket))
    heads = docs.groupBy("_bucket").agg(F.max_by(F.struct("doc_id", "text"), F.struct("doc_id", F.xxhash64("text"))).alias("head"))
    around = Window.orderBy("_bucket")
    numbers = docs.select("_bucket").distinct()
    numbers = numbers.select("_bucket", F.coalesce(F.lag("_bucket").over(around), F.max("_bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    guests = heads.join(numbers, "_bucket").select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.col("_before").alias("_bucket"), F.lit(True).alias("_guest"))
    rows = with_signature(docs.withColumn("_guest", F.lit(False)).unionByName(guests), "text", "_own")
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    rows = rows.select("*", F.lead("text").over(order).alias("_next_text"), F.lead("_own").over(order).alias("_next")).where("not _guest")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    taken = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - taken).cast("int")), F.substring("_next_text", F.lit(1), taken))
    rows = rows.select("doc_id", "n_chars", "_own", "_next", edited.alias("_edited_text"))
    rows = with_signature(rows, "_edited_text", "_edited")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited_text", 256).alias("edited_sha256"), as_text("_own").alias("fingerprint"), as_text("_edited").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"), likeness("_own", "_next").alias("near_next"),
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))
