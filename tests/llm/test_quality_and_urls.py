import zlib

import numpy as np
import pytest

from hawser.llm import quality, url_filter


def test_statistics_of_odd_texts():
    for text in ("", " ", "a", "\n\n", "é" * 100_000, "|" * 50, "\ud800"):
        values = quality.statistics(text)
        assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.fit(x, y, trees=80)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95

    def walk(row):  # one tree at a time, node by node
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(5)])
def test_no_or_one_label(y):
    score = quality.fit(np.zeros((len(y), 3)), y).score(np.zeros((2, 3)))
    assert ((score > 0) & (score < 1)).all()


def test_scores(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    trees = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, trees).select("doc_id", "score", "predicted", quality.held_out().alias("held_out")).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    held = [q == r.predicted for q, r in known if r.held_out]
    assert np.mean(held) > 0.85
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "", 1.0)], "doc_id long, text string, score double")
    assert quality.score_documents(odd, trees).count() == 3
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns
    assert quality.score_documents(odd.limit(0), trees).count() == 0


def test_labels_held_out_are_not_used(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(60)], "doc_id long, text string")
    flipped = spark.createDataFrame([(i, int((i > 30) ^ (zlib.crc32(str(i).encode()) % 3 == 1)), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([(i, int(i > 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = quality.train(docs, flipped), quality.train(docs, plain)
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.threshold, b.threshold)


URLS = [
    ("http://Sub.Example.NET/en/1", "sub.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://x.net/a?b=/c#d", "x.net", "/a", "net/", "block"),
    ("https://x.net?b", "x.net", "", None, None),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://ÄB.org#x", "Äb.org", "", None, None),
    ("http://h\n.net/p", "h\n.net", "/p", "net/", "block"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_urls_unlike_the_seeds(spark):
    urls = [("https://www.cheap-pills.example.org/en/5", "block"), ("https://free-casino.example.com/en/4", "block"), ("http://m.xxx-adult.example.org/es/1", "block"), ("https://blog.gardening.example.com/en/7", "allow"), ("https://www.ththre.example.org/en/9", "allow")]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame([(u,) for u, _ in urls], "url string")).collect()}
    assert got == dict(urls)
