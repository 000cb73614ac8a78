"""Benchmark decontamination by greedy string tiling.

Tokens are runs of Unicode letters, digits and combining marks after compatibility normalisation, lower-cased, so that
neither marks around words nor typographic forms hide anything; ideographs, kana and other letters of scripts without
spaces are a token each. The benchmark is the
stated query set: it is taken in blocks of bounded size, each broadcast and held against all documents map-side, so
no document moves. In a batch of documents, running Karp-Rabin hashes of `least_tile` tokens are looked up among the
benchmark's (shared-token seeds). For each document and item that meet, the longest matches of unmarked tokens are
marked again and again, longest first, and the marked share of the item is its coverage: an item whose sentences were
reordered is tiled in pieces and still covered.

A seed that more than COMMON items share (a licence line) brings an item and a document together only where such seeds
alone could cover the item; else a covered item has a tile with another seed, so nothing is missed.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

#: Shortest run of tokens that counts as a tile; shorter items must be found whole.
LEAST_TILE = 4
#: Items of fewer tokens are not searched, as a word alone says nothing; see `too_short`.
LEAST_ITEM = 2
#: Items that may share a seed before it counts as common.
COMMON = 64
#: Share of an item's tokens that must be tiled.
COVERAGE = 0.6
#: Characters of benchmark text held in one broadcast block.
BLOCK_CHARS = 8_000_000

RESULT = "doc_id long, item_id long, n_tiles int, matched int, item_tokens int, longest int, coverage double"

_BASE = 0x9E3779B97F4A7C15
# Blocks of scripts that are written without spaces.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


class _Separated(dict):
    """For str.translate: what a code point becomes, worked out when it is first met."""

    def __missing__(self, point: int):
        if any(a <= point <= b for a, b in _UNSPACED):
            out = f" {chr(point)} "
        else:
            out = point if unicodedata.category(chr(point))[0] in "LNM" else " "
        self[point] = out
        return out


_SEPARATED = _Separated()


def tokens(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_SEPARATED).split()


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every `n` neighbouring ids, modulo 2**64."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + ids[j : j + len(out)].astype(np.uint64)
    return out


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length): longest matches first, each token of either side in one tile at most.

    Equal lengths are taken by item start, then text start. The search length falls from the item's length to
    `least` by halves; at each length all maximal matches of at least that length are marked before it falls.
    """
    item_free, text_free, tiles = [True] * len(item), [True] * len(text), []
    search = len(item)
    while len(item) >= least:
        while True:
            found = _maximal_matches(item, text, item_free, text_free, search)
            marked = False
            for n, i, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
                if all(item_free[i : i + n]) and all(text_free[t : t + n]):
                    tiles.append((i, t, n))
                    item_free[i : i + n] = text_free[t : t + n] = [False] * n
                    marked = True
            if not marked:
                break
        if search == least:
            break
        search = max(least, search // 2)
    return tiles


def _maximal_matches(item, text, item_free, text_free, n) -> list[tuple[int, int, int]]:
    at = defaultdict(list)
    for i, h in _free_windows(item, item_free, n):
        at[h].append(i)
    out = []
    for t, h in _free_windows(text, text_free, n):
        for i in at.get(h, ()):
            if i and t and item_free[i - 1] and text_free[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of a longer match that starts before
            k = 0
            while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and item_free[i + k] and text_free[t + k]:
                k += 1
            if k >= n:  # hashes may agree by chance
                out.append((k, i, t))
    return out


def _free_windows(ids, free, n) -> Iterator[tuple[int, int]]:
    """Start and running Karp-Rabin hash of each window of `n` unmarked ids."""
    mask, top, h, run = (1 << 64) - 1, pow(_BASE, n - 1, 1 << 64), 0, 0
    for i, x in enumerate(ids):
        if not free[i]:
            h, run = 0, 0
            continue
        if run >= n:
            h -= ids[i - n] * top
        h = (h * _BASE + x) & mask
        run += 1
        if run >= n:
            yield i - n + 1, h


def _condensed(text: list[int], longest: int, least: int) -> list[int]:
    """A long repetitive `text` with as many copies of what repeats as tiles of `longest` tokens in all can need.

    There are at most longest / least tiles, and each blocks copies less than twice `longest` around it; so of equal
    windows one more than that, that far apart, leave room for every tile.
    """
    if len(text) <= 64 * longest:
        return text
    hashes = window_hashes(np.array(text + [0] * longest, np.int64), longest)[: len(text)]
    keep, seen = np.zeros(len(text) + longest, bool), {}
    for t, h in enumerate(hashes.tolist()):
        n, last = seen.get(h, (0, -2 * longest))
        if n <= longest // least and t - last >= 2 * longest:
            seen[h] = (n + 1, t)
            keep[t : t + longest] = True
    out, last = [], 0
    for t in np.nonzero(keep[: len(text)])[0].tolist():
        if out and t > last + 1:
            out.append(0)
        out.append(text[t])
        last = t
    return out


class Benchmark:
    """A block of benchmark items, ready to be held against documents."""

    def __init__(self, items: list[tuple[int, str]], least_tile: int, coverage: float):
        self.least, self.coverage, self.vocabulary, self.items = least_tile, coverage, {}, []
        for item_id, text in items:
            words = tokens(text)
            if len(words) >= LEAST_ITEM:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        self.seeds: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # by length and hash
        for number, (_, ids) in enumerate(self.items):
            n = min(least_tile, len(ids))
            for h in set(window_hashes(np.array(ids), n).tolist()):
                self.seeds[n][h].append(number)
        self.beside: dict[int, set[int]] = {}  # an item's common seeds, where they can't cover it
        for number, (_, ids) in enumerate(self.items):
            n, reached = min(least_tile, len(ids)), set()
            hashes = window_hashes(np.array(ids), n).tolist()
            common = {h for h in hashes if len(self.seeds[n][h]) > COMMON}
            for i, h in enumerate(hashes):
                if h in common:
                    reached.update(range(i, i + n))
            if common and len(reached) < coverage * len(ids):
                self.beside[number] = common
        for x in self.seeds.values():
            for h, numbers in x.items():
                if len(numbers) > COMMON:
                    x[h] = [k for k in numbers if h not in self.beside.get(k, ())]
        self.seeds = {n: dict(x) for n, x in self.seeds.items()}
        self.sorted_seeds = {n: np.array(sorted(x), np.uint64) for n, x in self.seeds.items()}

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(number of the text, number of the item, tiles) where the tiles cover enough of the item."""
        get, parts, starts, at = self.vocabulary.get, [], [], 0
        for text in texts:
            words = tokens(text)
            parts += [np.fromiter(map(get, words, itertools.repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
            starts.append(at)
            at += len(words) + 1
        if not parts:
            return
        ids, starts = np.concatenate(parts), np.array(starts)
        met: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, seeds in self.sorted_seeds.items():
            known = np.cumsum(np.concatenate([[0], ids != 0]))
            places = np.nonzero(known[n:] - known[:-n] == n)[0] if len(ids) >= n else np.empty(0, np.int64)
            if not len(places):
                continue
            h = window_hashes(ids, n)[places]
            hit = np.isin(h, seeds)
            places, h = places[hit], h[hit]
            hits = list(zip(places.tolist(), (np.searchsorted(starts, places, "right") - 1).tolist(), h.tolist(), strict=True))
            for place, number, value in hits:
                for item in self.seeds[n][value]:
                    met[number, item].append(place)
            if self.beside:
                of_text = defaultdict(list)
                for number, item in met:
                    if item in self.beside and min(self.least, len(self.items[item][1])) == n:
                        of_text[number].append(item)
                for place, number, value in hits:
                    for item in of_text.get(number, ()):
                        if value in self.beside[item]:
                            met[number, item].append(place)
                for number, items in of_text.items():
                    for item in items:
                        met[number, item].sort()
        for (number, item), places in met.items():
            pattern = self.items[item][1]
            n = min(self.least, len(pattern))
            # a tile lies within the document's seeds for this item: other tokens can't be part of one
            inside, last = [], -1
            for p in places:
                if p > last and inside:
                    inside.append(0)
                inside += ids[max(p, last) : p + n].tolist()
                last = p + n
            inside = _condensed(inside, len(pattern), n)
            present = set(inside)
            if sum(x in present for x in pattern) >= self.coverage * len(pattern):
                tiles = greedy_tiles(pattern, inside, n)
                if sum(t[2] for t in tiles) >= self.coverage * len(pattern):
                    yield number, item, tiles


def blocks(benchmark: DataFrame, least_tile: int, coverage: float, block_chars: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about `block_chars` characters; null texts have no tokens and match nothing."""
    items = benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Benchmark([tuple(r) for r in items.where(block == k).orderBy("item_id", "text").collect()], least_tile, coverage)


def too_short(benchmark: DataFrame) -> DataFrame:
    """item_id and text of the items that are not searched: null texts and those below LEAST_ITEM tokens."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(tokens(t)) for t in texts], dtype="int32")

    return benchmark.where(count(text_or_empty()) < LEAST_ITEM).select("item_id", "text")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least_tile: int = LEAST_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of RESULT: each document and benchmark item whose tiles reach the coverage.

    Null and empty texts match nothing; repeated rows give repeated results; items of fewer than LEAST_ITEM tokens are
    left out (`too_short` lists them), and those below `least_tile` must be found whole. Empty tables give no rows.
    """
    out = None
    for part in blocks(benchmark, least_tile, coverage, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def compare(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = shared.value
            for batch in batches:
                ids, rows = batch["doc_id"].tolist(), []
                for number, item, tiles in held.matches(batch["text"].tolist()):
                    item_id, pattern = held.items[item]
                    matched = sum(t[2] for t in tiles)
                    rows.append((ids[number], item_id, len(tiles), matched, len(pattern), max(t[2] for t in tiles), matched / len(pattern)))
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_tiles", "matched", "item_tokens", "longest", "coverage"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64", "n_tiles": "int32", "matched": "int32", "item_tokens": "int32", "longest": "int32", "coverage": "float64"})

        found = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(compare, RESULT)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_tile: int = LEAST_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pipeline stage: the documents in which no benchmark item is covered, with the columns they came with."""
    for part in blocks(benchmark, least_tile, coverage, block_chars):
        docs = docs.where(_is_clean(docs.sparkSession.sparkContext.broadcast(part))(text_or_empty()))
    return docs


def _is_clean(shared):
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        for number, _, _ in shared.value.matches(texts.tolist()):
            out[number] = False
        return pd.Series(out)

    return clean


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered benchmark items of every document; see `contaminated_pairs` for nulls, repeated rows and empty tables."""
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
