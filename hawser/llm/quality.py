"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from whole texts in Arrow batches; the trees are complete, so that each is three flat arrays
(feature, threshold, leaf) and a batch walks down all of them with numpy indexing.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

#: Labelled rows that the trees are fitted on at most: those with the smallest hash of doc_id.
TRAINING_ROWS = 12_000

_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "exclaim", "pipe", "hash", "percent", "dollar", "star", "and", "bracket", "markup", "quote", "other_ascii", "non_ascii"]
FEATURES = ["log_chars", "log_words", "mean_word", "max_word", "unique_words", "repeated_next", "log_lines", "unique_lines", "mean_line", "entropy", "compressed", *_CLASSES]


def _byte_classes() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)))
    single = {"\n": "newline", ".": "stop", ",": "comma", "!": "exclaim", "|": "pipe", "#": "hash", "%": "percent", "$": "dollar", "*": "star", "&": "and"}
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind = "non_ascii"
        elif c in single:
            kind = single[c]
        elif c.isupper():
            kind = "upper"
        elif c.islower():
            kind = "lower"
        elif c.isdigit():
            kind = "digit"
        elif c.isspace():
            kind = "space"
        elif c in "()[]{}":
            kind = "bracket"
        elif c in "<>/=\\":
            kind = "markup"
        elif c in "\"'":
            kind = "quote"
        else:
            kind = "other_ascii"
        out[b, _CLASSES.index(kind)] = 1
    return out


_CLASS_OF_BYTE = _byte_classes()


def statistics(text: str) -> list[float]:
    """The FEATURES of a whole text; all zero for an empty one."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    share = counts[counts > 0] / n
    n_words = max(1, len(words))
    return [
        math.log(n),
        math.log1p(len(words)),
        sum(map(len, words)) / n_words,
        math.log1p(max(map(len, words), default=0)),
        len(set(words)) / n_words,
        sum(map(operator.eq, words, words[1:])) / n_words,
        math.log(len(lines)),
        len(set(lines)) / len(lines),
        math.log(n / len(lines)),
        float(-(share * np.log2(share)).sum()),
        len(zlib.compress(data, 1)) / n,
        *(counts @ _CLASS_OF_BYTE / n),
    ]


@dataclass
class Trees:
    """Complete trees of one depth as flat arrays; node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of `x`."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least_hessian: float = 2.0, penalty: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms of quantile bins.

    Without rows, or with one label only, the trees are empty and the score is the share of label 1 (0.5 for no rows).
    """
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base, inner = math.log(share / (1 - share)), 2**depth - 1
    if not len(y) or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if trees else []
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1) if trees else x
    n_features, margin = x.shape[1], np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            g, h = np.zeros((n_features, width, bins)), np.zeros((n_features, width, bins))
            for f in range(n_features):
                place = at * bins + binned[:, f]
                g[f] = np.bincount(place, gradient, width * bins).reshape(width, bins)
                h[f] = np.bincount(place, hessian, width * bins).reshape(width, bins)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < least_hessian) | (right_h < least_hessian)] = 0
            for k in range(width):
                f, b = divmod(int(gain[:, k].argmax()), bins)
                if gain[f, k, b] > 1e-9 and b < len(edges[f]):
                    out.feature[t, first + k], out.threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node])
        at = node - inner
        g, h = np.bincount(at, gradient, inner + 1), np.bincount(at, hessian, inner + 1)
        out.leaf[t] = -rate * g / (h + penalty)
        margin += out.leaf[t][at]
    return out


def held_out(column: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Trees:
    """Trees fitted on labelled rows that aren't held out, at most `training_rows` of them.

    Labels without a doc_id or quality are left out; of several labels of a document the largest counts. The sample
    is bounded, so it is broadcast to the documents, and only statistics come to the driver.
    """
    sample = (
        labels.select("doc_id", "quality").dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    )
    labelled = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([statistics(t) for t in b["text"]], columns=FEATURES)
            yield out.assign(quality=b["quality"].to_numpy(), doc_id=b["doc_id"].to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", quality int, doc_id long"
    data = labelled.select("doc_id", "text", F.col("quality").cast("int")).mapInPandas(rows, schema).toPandas()
    data = data.sort_values(["doc_id", *FEATURES])  # the fit doesn't depend on the order in which tasks end
    return fit(data[FEATURES].to_numpy(dtype=float), data["quality"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """`docs` with score and predicted; null texts score as empty ones. Map-side: rows stay where they are."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))))

    return docs.withColumn("score", score(text_or_empty())).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that the classifier doesn't reject, with the columns they came with."""
    own = docs.columns
    return score_documents(docs, train(docs, labels)).filter("predicted = 1").select(*own)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return score_documents(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
