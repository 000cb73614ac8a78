import random

import pytest

from hawser.llm import decontamination as D


def plain_tiles(item, text, least):
    """Greedy string tiling as first described: the longest unmarked match again and again."""
    a, b, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and a[i + k] and b[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        k, i, t = best
        if k < least:
            return tiles
        tiles.append((i, t, k))
        a[i : i + k] = b[t : t + k] = [False] * k


@pytest.mark.parametrize("seed", range(60))
def test_tiles_cover_as_much_as_plain_tiling(seed):
    rng = random.Random(seed)
    item, text = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))], [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
    got, want = D.greedy_tiles(item, text, 3), plain_tiles(item, text, 3)
    for side in (0, 1):
        marked = [p for t in got for p in range(t[side], t[side] + t[2])]
        assert len(marked) == len(set(marked))
    assert all(item[i : i + n] == text[t : t + n] and n >= 3 for i, t, n in got)
    assert max((t[2] for t in got), default=0) == max((t[2] for t in want), default=0)
    assert abs(sum(t[2] for t in got) - sum(t[2] for t in want)) <= 3  # ties may be taken in another order


ITEM = "The quick brown fox jumps over the lazy dog while nineteen purple elephants calmly discuss modern poetry near the river bank"
FILLER = " ".join(f"filler{i}" for i in range(80))


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, coverage string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, {(r.doc_id, r.item_id): r for r in D.contaminated_pairs(d, b, **kw).collect()}


def test_copies_reordered_and_clean(spark):
    words = ITEM.split()
    reordered = " ".join(words[12:] + ["between"] + words[:12])
    docs = [
        (1, FILLER + " " + ITEM + " " + FILLER), (2, ITEM.upper().replace(" ", "*** ")), (3, FILLER + " " + reordered), (4, FILLER), (5, " ".join(words[:8])), (6, None), (7, ""),
        (8, "quick the dog fox over brown lazy the jumps " * 3), (None, ITEM), (1, ITEM), (9, "word " * 50_000 + ITEM),
    ]
    items = [(1, ITEM), (2, None), (3, ""), (4, "tiny item")]
    d, b, got = run(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (None, 1), (9, 1)}
    assert got[2, 1].coverage == 1.0 and got[2, 1].n_tiles == 1 and got[3, 1].n_tiles == 2
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    # the same in many blocks
    _, _, blocked = run(spark, docs, items, block_chars=40)
    assert {k: tuple(v) for k, v in blocked.items()} == {k: tuple(v) for k, v in got.items()}


def test_short_items_must_be_whole(spark):
    _, _, got = run(spark, [(1, "a tiny item here"), (2, "tiny thing"), (3, "item tiny")], [(4, "tiny item")])
    assert set(got) == {(1, 4)}


def test_empty_tables(spark):
    d, b, got = run(spark, [(1, ITEM)], [(1, ITEM)])
    assert D.contaminated_pairs(d.limit(0), b).count() == 0 and D.contaminated_pairs(d, b.limit(0)).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == 1


def test_query_against_plain_tiling(spark, small):
    got = {(r.doc_id, r.item_id) for r in D.op10_benchmark_decontamination(spark, small).collect()}
    number = {}
    ids = lambda text: [number.setdefault(w, len(number) + 1) for w in D.tokens(text)]
    items = [(r.item_id, ids(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = ids(r.text)
        present = {tuple(words[i : i + 4]) for i in range(len(words))}
        for item_id, item in items:
            covered = {p for i in range(len(item) - 3) if tuple(item[i : i + 4]) in present for p in range(i, i + 4)}
            if len(covered) >= 0.6 * len(item) and sum(t[2] for t in D.greedy_tiles(item, words, 4)) >= 0.6 * len(item):
                want.add((r.doc_id, item_id))
    assert got == want


def test_typography_scripts_and_single_words(spark):
    words = ITEM.split()
    han = "这是一个用来检查基准污染的句子其中没有任何空格"
    docs = [(1, "“" + "” — “".join(words) + "”…"), (2, " ".join(words)), (3, "　".join(words)), (4, f"前文内容{han}后文内容。"), (5, "see the cat"), (6, "ＴＨＥ " + ITEM[4:].replace("fi", "ﬁ"))]
    d, b, got = run(spark, docs, [(1, ITEM), (2, han), (3, "the"), (4, None)])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)}
    assert sorted(r.item_id for r in D.too_short(b).collect()) == [3, 4]
    assert sorted(r.doc_id for r in D.drop_contaminated(d, b).collect()) == [5]


def test_common_seeds_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    licence = "permission is hereby granted free of charge to any person".split()
    own = lambda i: [f"w{i}x{j}" for j in range(rng.randint(0, 14))]
    items = [(i, " ".join(licence + own(i))) for i in range(120)]
    docs = [(k, " ".join(rng.choice(items)[1].split()[rng.randint(0, 4) :] + [f"f{k}"] + licence[: rng.randint(0, 10)])) for k in range(60)] + [(99, " ".join(licence)), (98, " ".join(licence * 3_000))]
    _, _, got = run(spark, docs, items)
    held = D.Benchmark(items, D.LEAST_TILE, D.COVERAGE)
    assert held.beside
    monkeypatch.setattr(D, "COMMON", 10**9)
    plain = D.Benchmark(items, D.LEAST_TILE, D.COVERAGE)
    texts = [t for _, t in docs]
    assert sorted(plain.matches(texts)) == sorted(held.matches(texts))
    monkeypatch.setattr(D, "_condensed", lambda text, *_: text)
    covers = lambda found: sorted((n, i, sum(t[2] for t in tiles)) for n, i, tiles in found)
    short = [" ".join(t.split()[:900]) for t in texts]
    whole = covers(plain.matches(short))
    monkeypatch.undo()
    assert covers(plain.matches(short)) == whole
    assert {(docs[n][0], items[i][0]) for n, i, _ in plain.matches(texts)} == set(got)
