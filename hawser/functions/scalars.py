"""Formatting, hashing, classification and sizing rules, each a builder of a Spark Column.

Rules that were first-match ladders stay ladders; whole-number truncation happens where the rule truncates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
GIB = 1 << 30

# File extensions by class, and the extensions of archives whose contents can be listed.
EXTENSIONS = {
    "text": ["txt", "log", "csv", "json", "xml", "yaml", "yml"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "tiff"],
    "video": ["mp4", "avi", "mov", "wmv", "flv"],
    "audio": ["mp3", "wav", "flac", "ogg"],
    "compressed": ["zip", "gz", "bz2", "xz", "7z"],
    "document": ["pdf", "doc", "docx", "ppt", "pptx"],
    "binary": ["exe", "dll", "so", "dylib"],
}
LISTABLE = [".tar", ".br", ".bz2", ".zip", ".gz", ".lz4", ".sz", ".xz", ".zz", ".zst", ".rar", ".7z"]

# Storage classes by the price list's names, and codecs whose output counts as compressed.
CLASS_NAMES = {
    "General Purpose": "STANDARD", "Infrequent Access": "STANDARD_IA", "One Zone - Infrequent Access": "ONEZONE_IA",
    "Archive": "GLACIER", "Deep Archive": "DEEP_ARCHIVE", "Intelligent-Tiering": "INTELLIGENT_TIERING",
}
COMPRESSING = ["zstd", "gzip", "bzip2"]

# Error texts by category, first match wins, with whether a retry helps.
ERROR_WORDS = [
    ("network", True, ["connection", "timeout", "network", "dns"]),
    ("permission", False, ["access denied", "forbidden", "unauthorized", "permission"]),
    ("throttling", True, ["throttle", "rate limit", "too many requests", "slow down"]),
    ("validation", False, ["invalid", "bad request", "malformed"]),
]

# Fixed values: (content types, chunk multiplier).
CHUNK_FACTORS = [
    (["application/zip", "application/x-tar"], 1.3),
    (["video/mp4", "video/mov"], 1.4),
    (["image/jpeg", "image/png"], 1.1),
    (["text/plain", "application/json"], 0.8),
]

# Codec for a kind of data, when no priority is given.
CODEC_BY_KIND = {"image": "none", "video": "none", "audio": "none", "binary": "s2", "executable": "s2"}
CODEC_BY_PRIORITY = {"speed": "lz4", "size": "zstd", "balanced": "s2"}
# MB/s of a codec level before anything is measured; any other takes 100.
CODEC_SPEED = {"zstd-fast": 300.0, "zstd": 150.0, "zstd-high": 50.0, "zstd-max": 20.0}


def ladder(rules: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds; conditions that are null don't hold."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def truncated(value: Column) -> Column:
    """Toward zero, as a long."""
    return value.cast("long")


def fixed(value: Column, decimals: int) -> Column:
    """A double with so many decimals as C's printf rounds it: by its exact value, ties to the even digit.

    `format_string` rounds the shortest decimal form of the double, and ties up. The fraction's product with the power
    of ten is taken with its rounding error (Dekker), so it is exact. Numbers of 2**53 or more are whole and go to
    `format_string`, as do NaN and the infinities.
    """
    unit = 10**decimals
    size = F.abs(value)
    base = F.floor(size)
    part = size - base
    scaled = part * F.lit(float(unit))
    high = part * F.lit(134217729.0) - (part * F.lit(134217729.0) - part)
    error = (part - high) * F.lit(float(unit)) - (scaled - high * F.lit(float(unit)))
    whole = F.floor(scaled)
    over = scaled - whole
    odd = (whole if decimals else base) % 2 == 1
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & odd)))
    units = whole + F.when(up, 1).otherwise(0)
    digits = (base + F.when(units == unit, 1).otherwise(0) if decimals else base + units).cast("string")
    if decimals:
        digits = F.concat(digits, F.lit("."), F.lpad((units % unit).cast("string"), decimals, "0"))
    return F.when(size < F.lit(float(1 << 53)), F.concat(F.when(value < 0, "-").otherwise(""), digits)).otherwise(F.format_string(f"%.{decimals}f", value))


def human_bytes(size: Column, largest: str = "PB") -> Column:
    """`512 B`, `1.5 KB`: units of 1024 with one decimal, up to `largest`."""
    units = ["KB", "MB", "GB", "TB", "PB"]
    units = units[: units.index(largest) + 1]
    below = [size < F.lit(1 << (10 * (i + 2))) for i in range(len(units) - 1)]
    scaled = size / ladder([(b, float(1 << (10 * (i + 1)))) for i, b in enumerate(below)], float(1 << (10 * len(units))))
    text = F.concat(fixed(scaled, 1), ladder([(b, f" {u}") for b, u in zip(below, units, strict=False)], f" {largest}"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(text)


def human_bytes_si(size: Column, largest: str = "EB") -> Column:
    """`3.0 kB`: units of 1000 up to `largest`; one decimal below ten of a unit (not of EB), none above."""
    units = ["kB", "MB", "GB", "TB", "PB"]
    units = units[: units.index(largest) + 1] if largest != "EB" else units
    rules = [(size < 10, F.format_string("%d B", size)), (size < 1000, F.format_string("%d B", size))]
    for i, u in enumerate(units):
        scaled = F.floor(size / F.lit(float(10 ** (3 * i + 3))) * 10 + 0.5) / 10
        text = F.when(scaled < 10, F.format_string(f"%.1f {u}", scaled)).otherwise(F.concat(F.bround(scaled, 0).cast("long").cast("string"), F.lit(f" {u}")))
        rules.append((F.lit(True) if u == largest else size < F.lit(10 ** (3 * i + 6)), text))
    return ladder(rules, F.concat(F.bround(size / F.lit(1e18), 0).cast("long").cast("string"), F.lit(" EB")))


def parse_bytes(text: Column) -> Column:
    """Bytes of `16MB`, `2 gb`, `512`: units of 1024 in any case; null when it can't be read."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 2))
    factor = ladder([(unit.isin("", "B"), 1.0), *((unit.isin(u, f"{u}B"), float(1 << (10 * (i + 1)))) for i, u in enumerate("KMGTP"))], F.lit(None).cast("double"))
    return F.when(number != "", truncated(F.try_to_number(number, F.lit("999999999999999999.999999")).cast("double") * factor))


def human_duration(seconds: Column) -> Column:
    """`42s`, `3m 5s`, `2h 7m`; `0s` for nothing or less."""
    whole = F.floor(seconds).cast("long")
    return ladder(
        [
            (seconds <= 0, "0s"),
            (seconds < 60, F.concat(fixed(seconds.cast("double"), 0), F.lit("s"))),
            (seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)),
        ],
        F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole / 60) % 60),
    )


def fnv1a_32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a long from 0 to 2**32 - 1."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    byte = lambda h: F.conv(h, 16, 10).cast("long")
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(byte(b)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295)))


def extension_class(name: Column) -> Column:
    """Class of a file by its extension, case as written."""
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return ladder([(name == "", "unknown"), (~F.contains(name, F.lit(".")), "no_extension"), *((ext.isin(v), k) for k, v in EXTENSIONS.items())], "other")


def is_listable(name: Column) -> Column:
    """Whether the file is an archive whose table of contents can be read."""
    out = F.lit(False)
    for ext in LISTABLE:
        out = out | F.endswith(name, F.lit(ext))
    return out


def glob_to_regex(pattern: str) -> str:
    """Regular expression of a shell glob (`*`, `?`, `[...]`) on a base name; a broken pattern matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            close = pattern.find("]", i + 2)
            if close < 0:
                return r"(?!)"
            body = pattern[i + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if not c.isalnum() else c)
        i += 1
    return f"^{out}$"


def matches_globs(name: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | name.rlike(glob_to_regex(g))
    return out


def error_category(message: Column) -> Column:
    """struct(category, retryable) of an error text; unknown texts may be retried."""
    low = F.lower(message)
    of = lambda kind, retry: F.struct(F.lit(kind).alias("category"), F.lit(retry).alias("retryable"))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return ladder([(any_of(words), of(kind, retry)) for kind, retry, words in ERROR_WORDS], of("unknown", True))


def storage_class(pattern: Column, retention_days: Column, default: str = "STANDARD") -> Column:
    """Storage class for an access pattern and retention."""
    none = F.coalesce(pattern, F.lit("")) == ""
    return ladder(
        [
            (none & (retention_days == 0), default),
            ((pattern == "archive") & (retention_days > 365), "DEEP_ARCHIVE"),
            ((retention_days > 90) | (pattern == "rare"), "GLACIER"),
            (pattern == "infrequent", "STANDARD_IA"),
            (none | (pattern == "unknown"), "INTELLIGENT_TIERING"),
        ],
        "STANDARD",
    )


def recommended_codec(kind: Column, priority: Column) -> Column:
    by_priority = [(priority == p, c) for p, c in CODEC_BY_PRIORITY.items()]
    return ladder(by_priority + [(kind == k, c) for k, c in CODEC_BY_KIND.items()], "zstd")


def prefix_count(total_bytes: Column) -> Column:
    gb = total_bytes / F.lit(float(GIB))
    return ladder([(gb < 1, 1), (gb < 10, 2), (gb < 100, 4), (gb < 1000, 8)], 16).cast("long")


def prefix_pattern(total_bytes: Column, archives: Column) -> Column:
    return ladder([(archives < 100, "sequential"), (total_bytes / F.lit(float(GIB)) > 100, "hash")], "date")


def network_condition(bandwidth: Column) -> Column:
    return ladder([(bandwidth < 1, "poor"), (bandwidth < 5, "fair"), (bandwidth < 25, "good")], "excellent")


def optimal_chunk(size: Column, bandwidth: Column, latency_ms: Column, content_type: Column, historical: Column, least: int = 5 * MIB, most: int = 100 * MIB) -> Column:
    """Upload chunk in bytes: by size, scaled for the network and content, blended 70:30 with history, clamped.

    Each stage truncates to whole bytes. A null or non-positive bandwidth leaves the network out, a null history the blend.
    """
    base = ladder([(size < 100 * MIB, 8 * MIB), (size < GIB, 16 * MIB), (size < 10 * GIB, 32 * MIB)], 64 * MIB)
    by_bandwidth = ladder([(bandwidth < 1, 0.5), (bandwidth < 5, 0.75), (bandwidth < 25, 1.0)], 1.5)
    by_latency = ladder([(latency_ms > 500, 1.5), (latency_ms > 200, 1.2)], 1.0)
    network = F.when(bandwidth > 0, truncated(base * by_bandwidth * by_latency)).otherwise(base)
    content = truncated(network * ladder([(content_type.isin(types), f) for types, f in CHUNK_FACTORS], 1.0))
    blended = F.when(historical.isNull(), content).otherwise(truncated(0.7 * content + 0.3 * historical))
    return F.greatest(F.least(blended, F.lit(most)), F.lit(least)).cast("long")


def optimal_concurrency(size: Column, chunk: Column, bandwidth: Column, most: int = 8) -> Column:
    base = ladder([(bandwidth < 1, 2), (bandwidth < 5, 4), (bandwidth < 25, 8)], most)
    return F.least(base, F.ceil(size / chunk)).cast("long")


def upload_seconds(size: Column, concurrency: Column, bandwidth: Column) -> Column:
    """Estimated seconds; more concurrency lowers the effective bandwidth. Unknown bandwidth counts as 5 MB/s."""
    known = F.when(bandwidth > 0, bandwidth).otherwise(5.0)
    return F.try_divide(size / F.lit(float(MIB)), known * (0.7 + F.try_divide(F.lit(0.3), concurrency)))


def codec_seconds(size: Column, codec: Column) -> Column:
    return size / F.lit(float(MIB)) / ladder([(codec == k, v) for k, v in CODEC_SPEED.items()], 100.0)


def adaptive_codec(bandwidth: Column, latency_ms: Column) -> Column:
    return ladder([(bandwidth > 100, "zstd-fast"), (bandwidth < 20, "zstd-high"), (latency_ms > 100, "zstd-high")], "zstd")


def bounded(value: Column, least: float, most: float) -> Column:
    return F.greatest(F.least(value, F.lit(most)), F.lit(least))


def backoff_ms(in_flight: Column, window: Column) -> Column:
    """Doubling from 100 ms for each upload over the window, 30 s at most; without jitter."""
    return F.least(100.0 * F.pow(F.lit(2.0), (in_flight - window).cast("double")), F.lit(30000.0))


def priority_factor(priority: Column) -> Column:
    return ladder([(priority == 1, 0.5), (priority == 2, 0.75), (priority == 4, 1.25), (priority == 5, 1.5)], 1.0)


def ratio_from_entropy(entropy: Column) -> Column:
    return ladder([(entropy < 1, 0.9), (entropy < 2, 0.8), (entropy < 4, 0.6), (entropy < 6, 0.4), (entropy < 7, 0.2)], 0.05)


def ratio_from_content(kind: Column) -> Column:
    return ladder(
        [
            (kind == "text", 0.7), (kind.isin("json", "xml"), 0.6), (kind == "binary", 0.4), (kind.isin("image_jpeg", "image_png"), 0.05),
            (kind == "pdf", 0.3), (kind.isin("zip", "compressed"), 0.02), (kind == "document", 0.5),
        ],
        0.3,
    )


def price_class(name: Column) -> Column:
    """Class code of a price list's name; null for names it doesn't know."""
    return ladder([(name == n, c) for n, c in CLASS_NAMES.items()], F.lit(None).cast("string"))


def staged_type(codec: Column) -> Column:
    """Content type that staging assumes for a codec's output."""
    return F.when(codec.isin(COMPRESSING), "compressed").otherwise("binary")
