"""URL filter: rules first, then logistic regression on hashed character n-grams; DataFrame functions only.

The regression is fitted on the small table SEEDS of labelled URLs (its features come from the same expression as
those of the pages, its few weights are worked out on the driver) and applied as one array of weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

GRAMS = (3, 4)
BUCKETS = 4096

#: Labelled URLs: 1 is to be blocked.
SEEDS = [
    (1, "https://www.casino-royal.example.org/en/12"), (1, "http://best-casino.example.com/slots/bonus"), (1, "https://casino-win.example.org/en/7"),
    (1, "https://free-bets.example.com/en/3"), (1, "http://m.sport-bets.example.org/fr/18"), (1, "https://poker-bonus.example.com/en/88?ref=x"),
    (1, "https://cheap-pills.example.com/en/5"), (1, "http://online-pharmacy-pills.example.org/order"), (1, "https://buy-viagra.example.com/cheap/12.html"),
    (1, "https://adult-x.example.com/en/2"), (1, "http://xxx-video.example.org/adult/4"), (1, "https://www.porn-tube.example.com/es/9"),
    (1, "https://sex-cams.example.org/live"), (1, "https://ads-track.example.com/click/77"), (1, "http://adserver.example.org/track?id=5"),
    (1, "https://click-track.example.com/en/41"), (1, "https://banner-ads.example.org/fr/6"), (1, "https://spam-farm.example.com/en/10"),
    (1, "http://link-farm.example.org/links/3"), (1, "https://seo-spam.example.com/es/31"), (1, "https://free-download-crack.example.org/keygen"),
    (1, "http://warez-crack.example.com/download/2"), (1, "https://win-prize.example.org/lottery"), (1, "https://payday-loans.example.com/en/23"),
    (1, "http://m.adult-video.example.org/en/21"), (1, "https://xxx-photos.example.com/en/8"), (1, "https://blog.casino-bonus.example.com/fr/2"),
    (1, "https://www.track-ads.example.org/en/64"), (1, "http://pills-shop.example.com/en/9"), (1, "https://m.spam-links.example.org/en/17"),
    (0, "https://www.library.example.org/en/12"), (0, "http://blog.weather.example.com/en/3"), (0, "https://news.example.org/fr/18"),
    (0, "https://docs.python.example.org/en/7"), (0, "http://m.history.example.com/es/88?page=2&ref=x"), (0, "https://wiki.science.example.org/fr/5"),
    (0, "https://www.museum.example.com/en/25#top"), (0, "http://university.example.org/en/2"), (0, "https://m.garden.example.com/fr/4"),
    (0, "https://blog.recipes.example.org/es/9"), (0, "https://www.school.example.com/en/41/"), (0, "http://cityhall.example.org/en/77"),
    (0, "https://travel.example.com/en/10?utm_source=feed"), (0, "https://m.health.example.org/en/6"), (0, "http://forum.example.com/en/31.html"),
    (0, "https://www.theatre.example.org/fr/23"), (0, "https://blog.mathematics.example.com/en/44"), (0, "http://www.thinking.example.org/es/15"),
    (0, "https://m.northern.example.com/en/58"), (0, "https://www.other.example.org/en/61/"), (0, "https://blog.either.example.com/fr/70"),
    (0, "http://together.example.org/en/83"), (0, "https://www.mother.example.com/es/91?page=3"), (0, "https://m.nothing.example.org/en/36"),
    (0, "https://blog.station.example.com/en/29"), (0, "https://www.nation.example.org/fr/13"), (0, "http://m.table.example.com/en/47"),
    (0, "https://method.example.org/en/52#top"), (0, "https://blog.earth.example.com/es/64"), (0, "https://www.fresh.example.org/en/75.html"),
    (0, "http://weather.example.com/en/82"), (0, "https://m.english.example.org/fr/97"), (0, "https://blog.radio.example.com/en/19"),
    (0, "https://www.river.example.org/en/33"), (0, "https://music.example.com/en/55/"), (0, "http://m.ocean.example.org/es/66?utm_source=feed"),
]


def with_host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), pattern, i), F.lit(""))
    return urls.withColumns({"host": F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": part(2)})


def longest_rule(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits `host` and `path`, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def hashed_grams() -> Column:
    """Buckets of the n-grams of host and path, each with marks of its own at both ends, repeats included.

    Digits count as one character, as page numbers say nothing of a site.
    """

    def of(text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    texts = [F.translate(F.concat(F.lit(a), F.col(c), F.lit(b)), "123456789", "000000000") for c, a, b in (("host", "^", "$"), ("path", "<", ">"))]
    return F.concat(*(of(t, n) for t in texts for n in GRAMS))


def fit(rows: list[tuple[int, list[int]]], steps: int = 400, rate: float = 0.5, penalty: float = 2e-3) -> tuple[float, list[float]]:
    """Bias and weights by gradient descent on the logistic loss; features are scaled by the root of their number."""
    bias, weights = 0.0, [0.0] * BUCKETS
    for _ in range(steps):
        by_bucket, by_bias = {}, 0.0
        for label, grams in rows:
            scale = 1 / math.sqrt(max(1, len(grams)))
            p = 1 / (1 + math.exp(-(bias + scale * sum(weights[g] for g in grams))))
            by_bias += p - label
            for g in grams:
                by_bucket[g] = by_bucket.get(g, 0.0) + (p - label) * scale
        bias -= rate * by_bias / len(rows)
        weights = [w * (1 - rate * penalty) for w in weights]
        for g, d in by_bucket.items():
            weights[g] -= rate * d / len(rows) * 8
    return bias, weights


def judge(pages: DataFrame, seeds=SEEDS, rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, score (how surely to be blocked) and verdict, map-side.

    The longest fitting rule decides; without one, the regression: block from a score of 0.5 on. Null urls have an
    empty host and path and are judged by the regression like others.
    """
    labelled = with_host_and_path(pages.sparkSession.createDataFrame(seeds, "label int, url string")).select("label", hashed_grams().alias("grams"))
    bias, weights = fit([(r["label"], r["grams"]) for r in labelled.collect()])  # as many rows as there are seeds
    table_ = F.array(*map(F.lit, weights))
    judged = with_host_and_path(pages).withColumns({"_fit": longest_rule(rules), "_grams": hashed_grams()})
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + table_[g])
    judged = judged.withColumn("score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size("_grams"), F.lit(1)))))))
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.withColumns({"rule": F.col("_fit.rule"), "verdict": verdict}).drop("_fit", "_grams")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
