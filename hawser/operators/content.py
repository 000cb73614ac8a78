"""Byte content: entropy, type, windows, patterns, compressibility, boundary candidates."""

from __future__ import annotations

import bisect
import bz2
import gzip
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bounded, ladder, ratio_from_content, ratio_from_entropy

MIB = 1 << 20


def byte_entropy(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per row: key, bytes and Shannon entropy in bits of the UTF-8 bytes; an empty or null text has entropy 0.

    Bytes are counted in Arrow batches, one histogram a text: exploding them in SQL costs some fifty times more.
    """
    def of(value: str) -> float:
        data = value.encode("utf-8", "replace")
        counts = np.bincount(np.frombuffer(data, np.uint8))
        share = counts[counts > 0] / max(len(data), 1)
        return float(-(share * np.log2(share)).sum()) + 0.0

    @F.pandas_udf("double")
    def entropy(values: pd.Series) -> pd.Series:
        return values.map(of)

    whole = F.coalesce(F.col(text), F.lit(""))
    return texts.select(key, F.octet_length(whole).cast("long").alias("bytes"), entropy(whole).alias("entropy"))


def classify(text: Column) -> Column:
    """Type by the first bytes, else by the share of printable ASCII among the first 1024 bytes; `empty` for none."""
    data = F.encode(text, "UTF-8")
    head = F.hex(F.substring(data, F.lit(1), F.lit(1024)))
    # Leading bytes by type.
    magic = [("text", "74657874"), ("json", "7B"), ("xml", "3C3F786D6C"), ("binary", "00"), ("image_jpeg", "FFD8FF"), ("image_png", "89504E47"), ("pdf", "25504446"), ("zip", "504B0304")]
    rules = [(F.length(data) == 0, "empty"), *((F.startswith(head, F.lit(m)), kind) for kind, m in magic)]
    printable = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda b: b.between("20", "7E") | b.isin("09", "0A", "0D")))
    return ladder([*rules, (printable / (F.length(head) / 2) > 0.8, "text")], "binary")


def structure_density(text: Column) -> Column:
    """Share of the characters {}[]<>": in a text."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\{\}\[\]<>\":]", "")), F.length(text))


def windows(texts: DataFrame, key: str, text: str = "text", width: int = 16384) -> DataFrame:
    """Tumbling windows of `width` characters: (key, window, content)."""
    n = F.ceil(F.length(text) / F.lit(float(width)))
    rows = texts.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("window"))
    return rows.select(key, "window", F.substring(F.col(text), (F.col("window") * width + 1).cast("int"), F.lit(width)).alias("content"))


def compression_estimate(entropy: Column, kind: Column) -> Column:
    """Share that compression is expected to save, from entropy and type; 1 for entropy 0."""
    factor = ladder([(kind == "text", 0.3), (kind == "image", 0.8), (kind == "compressed", 0.95), (kind == "binary", 0.6)], 0.5)
    return F.when(entropy == 0, 1.0).otherwise(bounded((1.0 - entropy / 8.0) * factor, 0.1, 0.9))


def predicted_ratio(entropy: Column, kind: Column, pattern_ratio: Column, historical: Column) -> Column:
    """0.4 entropy band + 0.4 type + 0.2 patterns, blended 70:30 with history where there is some; 0.05 to 0.95."""
    now = ratio_from_entropy(entropy) * 0.4 + ratio_from_content(kind) * 0.4 + pattern_ratio * 0.2
    return bounded(F.when(historical > 0, now * 0.7 + historical * 0.3).otherwise(now), 0.05, 0.95)


# By pattern type, the typical entropy and the share that compresses away.
PATTERN_ENTROPY = {"repetitive": 1.0, "random": 8.0, "structured": 3.0, "binary": 6.0, "text": 4.0}
PATTERN_RATIO = {"repetitive": 0.95, "structured": 0.7, "text": 0.6, "binary": 0.4, "random": 0.05}


def pattern_profile(patterns: DataFrame, key: str) -> DataFrame:
    """Per key of patterns (type, length, frequency): typical entropy, and compressibility normalised by plain length."""
    weight = F.col("length") * F.col("frequency")
    entropy = ladder([(F.col("type") == t, e) for t, e in PATTERN_ENTROPY.items()], 4.0)
    ratio = ladder([(F.col("type") == t, r) for t, r in PATTERN_RATIO.items()], 0.0)
    return patterns.groupBy(key).agg(
        F.coalesce(F.try_divide(F.sum(entropy * weight), F.sum(weight)), F.lit(4.0)).alias("entropy"),
        F.coalesce(F.try_divide(F.sum(ratio * weight), F.sum("length").cast("double")), F.lit(0.3)).alias("ratio"),
    )


def optimal_for_network(size: Column) -> Column:
    return size.between(5 * MIB, 100 * MIB)


def alignment_score(size: Column, aligned: Column, target: float) -> Column:
    fit = F.greatest(1.0 - F.abs(size - F.lit(target)) / F.lit(target), F.lit(0.0))
    return F.least(F.when(aligned, 0.4).otherwise(0.0) + F.when(optimal_for_network(size), 0.3).otherwise(0.0) + fit * 0.3, F.lit(1.0))


def quality_score(alignment: Column, compression: Column, size: Column) -> Column:
    return alignment * 0.3 + compression * 0.4 + F.when(optimal_for_network(size), 1.0).otherwise(0.0) * 0.3


def composite_score(compression: Column, alignment: Column, size: Column, target: float) -> Column:
    return compression * 0.4 + alignment * 0.3 + F.greatest(1.0 - F.abs(size - F.lit(target)) / F.lit(target), F.lit(0.0)) * 0.3


def tar_headers(contents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Members of ustar archives by their 512-byte headers: (key, offset, name, size); the last block counts, too."""
    n = F.floor(F.length(content) / 512)
    at = contents.where(F.length(content) >= 512).select(key, content, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    piece = lambda start, size: F.substring(F.col(content), (F.col("block") * 512 + start + 1).cast("int"), F.lit(size))
    text = lambda b: F.regexp_replace(F.decode(b, "ISO-8859-1"), r"(?s)\x00.*$", "")
    octal = F.regexp_replace(text(piece(124, 12)), "[^0-7]", "")
    found = at.where(F.hex(piece(257, 5)) == "7573746172").select(key, (F.col("block") * 512).alias("offset"), text(piece(0, 100)).alias("name"), F.coalesce(F.conv(octal, 8, 10).cast("long"), F.lit(0)).alias("size"))
    return found.where("name <> ''")


#: Boundaries that keep_apart holds before it decides over them.
BOUNDARIES_HELD = 50_000


def _fates(starts: list, ends: list, tolerance: int, edge: float) -> list[int]:
    """1, 0 or -1 for each boundary in order: kept, left out, or open, as boundaries that start at `edge` or later may decide it."""
    cells: dict[tuple, list[tuple]] = {}
    out = []
    for a, b in zip(starts, ends, strict=True):
        i, j = a // tolerance, b // tolerance
        near = [fate for di in (-1, 0, 1) for dj in (-1, 0, 1) for x, y, fate in cells.get((i + di, j + dj), ()) if abs(a - x) < tolerance and abs(b - y) < tolerance]
        fate = 0 if 1 in near else -1 if near or a > edge - tolerance else 1
        if fate:
            cells.setdefault((i, j), []).append((a, b, fate))
        out.append(fate)
    return out


def keep_apart(candidates: DataFrame, shard: str, tolerance: int = 1024) -> DataFrame:
    """Boundaries (shard, ordinal, start_offset, end_offset) less those near one kept before: both ends within `tolerance`.

    Keep-first is sequential within a shard, but a boundary meets only those that start within `tolerance` of it. So a
    shard is one stream sorted by start, and the boundaries held are decided in order of ordinal, except those whose
    fate hangs on boundaries to come: within `tolerance` of the last start, or near an open one of smaller ordinal. Only
    these are held on. Boundaries without both offsets are near none; a null shard is a shard, a null ordinal the first.
    """
    ordered = candidates.select(shard, "ordinal", "start_offset", "end_offset").repartition(shard).sortWithinPartitions(shard, "start_offset")
    columns = ["ordinal", "start_offset", "end_offset"]

    def keep(batches):
        of, held, n, most = None, [], 0, BOUNDARIES_HELD

        def decided(edge: float) -> pd.DataFrame:
            nonlocal held, n, most
            ordinal, start, end = (np.concatenate(c) for c in zip(*held, strict=True))
            far = np.diff(start) >= tolerance
            fate = np.where(np.concatenate([[True], far]) & np.concatenate([far, [edge == np.inf]]), 1, -1)
            met = np.flatnonzero(fate < 0)
            met = met[np.lexsort((end[met], start[met], np.where(np.isnan(ordinal[met]), -np.inf, ordinal[met]) if ordinal.dtype.kind == "f" else ordinal[met]))]
            fate[met] = _fates(start[met].tolist(), end[met].tolist(), tolerance, edge)
            left = fate < 0
            held = [(ordinal[left], start[left], end[left])] if left.any() else []
            n = int(left.sum())
            most = max(BOUNDARIES_HELD, 2 * n)
            kept = fate > 0
            return pd.DataFrame({shard: pd.Series([of] * int(kept.sum()), dtype=kind), "ordinal": ordinal[kept], "start_offset": start[kept], "end_offset": end[kept]})

        kind = None
        for batch in batches:
            placed = batch["start_offset"].notna() & batch["end_offset"].notna()
            if not placed.all():
                yield batch[~placed]
                batch = batch[placed].astype({"start_offset": "int64", "end_offset": "int64"})
            kind = batch[shard].dtype
            for s, part in batch.groupby(shard, sort=False, dropna=False):
                if held and not (s == of or pd.isna(s) and pd.isna(of)):
                    yield decided(np.inf)
                of = s
                held.append(tuple(part[c].to_numpy() for c in columns))
                n += len(part)
                if n > most:
                    yield decided(held[-1][1][-1])
        if held:
            yield decided(np.inf)

    return ordered.mapInPandas(keep, f"`{shard}` {dict(candidates.dtypes)[shard]}, ordinal long, start_offset long, end_offset long")


#: Places of a text whose eight bytes are compared with all later ones at once.
_PROBES = 4096


def _likely_periods(data: np.ndarray, least: int, most: int, times: int) -> list[int]:
    """The periods from `least` to `most` with which `data` may repeat a block `times` times; all others surely don't.

    A stretch of a period has (times - 1) * period or more bytes that equal the one a period later, so all eight bytes
    from a place do at seven places less, and one place in `step` is enough to see a stretch of the shortest period.
    Longer ones are seen at several such places in a row.
    """
    step = (times - 1) * least - 7
    if step < 1 or len(data) < least + 8:
        return list(range(least, most + 1))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(most + 8, np.uint8)]), 8).copy().view(np.uint64)[:, 0]
    probes = np.arange(0, len(data) - least - 7, step)
    later = np.lib.stride_tricks.sliding_window_view(eight, most + 1)[:, least:]
    hits = sum((later[at] == eight[at, None]).sum(axis=0) for at in (probes[k : k + _PROBES] for k in range(0, len(probes), _PROBES)))
    out = []
    for period in range(least, most + 1):
        run = ((times - 1) * period - 7) // step
        if hits[period - least] >= run:
            if run > 1:
                so_far = np.concatenate([[0], np.cumsum(eight[probes] == eight[probes + period])])
                if not (so_far[run:] - so_far[:-run] == run).any():
                    continue
            out.append(period)
    return out


def repeats(texts: DataFrame, key: str, text: str = "text", least: int = 16, times: int = 3) -> DataFrame:
    """Patterns of the UTF-8 bytes: (key, offset, length, period, kind).

    `repetitive`: a block of `least` to 256 bytes stands `times` or more times in a row. A byte that equals the one a
    period later extends the stretch, so each period is one pass, if probes of the text allow it; a stretch is left out only where it lies inside one
    of a divisor of its period. `random`: a tumbling window of 1024 bytes of over 7 bits of entropy, without period.
    """
    def stretches(data: np.ndarray):
        found: dict[int, tuple[list[int], list[int]]] = {}
        for period in _likely_periods(data, least, min(256, len(data) // times), times):
            same = np.concatenate([[False], data[period:] == data[:-period], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            a, b = edges[::2], edges[1::2]
            enough = b - a >= (times - 1) * period
            done, starts, ends = 0, [], []
            for start, end in zip(a[enough].tolist(), b[enough].tolist(), strict=True):
                start = max(start, done)  # blocks don't overlap those of the stretch before
                count = 1 + (end - start) // period
                if count < times:
                    continue
                done = start + count * period
                starts.append(start)
                ends.append(done)
                of_divisors = (found[d] for d in found if period % d == 0)
                if not any((i := bisect.bisect_right(s, start)) and e[i - 1] >= done for s, e in of_divisors):
                    yield start, done - start, period, "repetitive"
            if starts:
                found[period] = starts, ends

    def random_windows(data: np.ndarray):
        for at in range(0, len(data), 1024):
            counts = np.bincount(data[at : at + 1024])
            n = int(counts.sum())
            share = counts[counts > 0] / n
            if -(share * np.log2(share)).sum() > 7.0:
                yield at, n, None, "random"

    def find(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                data = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
                rows += [(k, *row) for of in (stretches, random_windows) for row in of(data)]
            yield pd.DataFrame(rows, columns=["key", "offset", "length", "period", "kind"]).astype({"period": "Int32"})

    return texts.select(key, text).mapInPandas(find, "key long, offset long, length long, period int, kind string").withColumnRenamed("key", key)


def codec_trials(texts: DataFrame, key: str, text: str = "text", levels: tuple[int, ...] = (1, 6, 9)) -> DataFrame:
    """(key, codec, level, original, compressed): sizes of each text under zlib, gzip and bz2, whole texts."""
    def measure(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                data = (t or "").encode("utf-8", "replace")
                for level in levels:
                    rows += [(k, "zlib", level, len(data), len(zlib.compress(data, level))), (k, "gzip", level, len(data), len(gzip.compress(data, level, mtime=0))), (k, "bz2", level, len(data), len(bz2.compress(data, level)))]
            yield pd.DataFrame(rows, columns=["key", "codec", "level", "original", "compressed"])

    return texts.select(key, text).mapInPandas(measure, "key long, codec string, level int, original long, compressed long").withColumnRenamed("key", key)
