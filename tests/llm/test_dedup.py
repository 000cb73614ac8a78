import random

import numpy as np
import xxhash

from hawser.llm import simhash
from hawser.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"  # clashing names


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in lowered:
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if cur:
        words.append(cur)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in ("", " \n", "One", "a b", "A b\u00a0c  D\te f", "x y z x y z", "\u1680a b c É é"):
        assert simhash.fingerprint(text) == plain_fingerprint(text), repr(text)


def test_links_of_random_and_crowded_fingerprints(spark):
    rng = random.Random(11)
    base = rng.getrandbits(64)
    crowd = {base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 40, 2) for b in range(1, 9) for c in (50, 60)}  # hundreds within few bits
    chain = [base ^ (1 << 63)]
    for i in range(20):
        chain.append(chain[-1] ^ (3 << (2 * i)))
    fps = sorted(crowd | set(chain) | {rng.getrandbits(64) for _ in range(100)} | {0, 3, (1 << 64) - 1})
    signed = [simhash._signed(f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=16)
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = plain_components(fps)
    labels = [got.get(s, s) for s in signed]
    groups = {}
    for w, label in zip(want, labels, strict=True):
        groups.setdefault(w, set()).add(label)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(2)
    base = " ".join(rng.choice(words) for _ in range(400))
    rows = [(10, base), (11, base), (5, base + " tail"), (12, base.replace("w1 ", "w2 ", 1)), (20, "entirely other words here"), (30, ""), (31, None), (32, "  "), (None, base), (20, "entirely other words here")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows if r[0] is not None]
    fps = [plain_fingerprint(r[1]) for r in rows if r[0] is not None]
    roots = plain_components(fps)
    want = {i: min(ids[k] for k in range(len(ids)) if roots[k] == root) for i, root in zip(ids, roots, strict=True)}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(0).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 302
    assert connected_components(edges.limit(0)).count() == 0
