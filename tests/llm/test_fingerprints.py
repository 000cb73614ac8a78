import hashlib
import random

from pyspark.sql import functions as F

from hawser.llm import order_minhash as O


def signatures(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r.s for r in O.with_signature(df, "text", "s").select("id", "s").collect()}


def test_equal_and_edited_texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base), "\n ".join(base), " ".join(base[:390] + ["new"] * 10), " ".join(base[200:] + base[:200]), " ".join(rng.sample(base, len(base))), "", None, " \t", "a b", "a b", "b a", "x " * 3000, "x " * 2000]
    s = signatures(spark, texts)
    like = lambda i, j: len(set(s[i]) & set(s[j])) / max(1, len({x >> 27 for x in s[i]} | {x >> 27 for x in s[j]}))
    assert s[0] == s[1] and s[5] == s[6] == s[7] == [] and s[8] == s[9] != s[10]
    # a small edit keeps most; moving half the text keeps the words but not the order
    assert like(0, 2) > 0.7 > like(0, 3) > 0.2 and like(0, 4) < 0.1
    assert all(len({x >> 27 for x in v}) == len(v) <= O.BINS for v in s.values())
    assert s[11] != s[12]  # repeats count


def numbered(words, k=O.K):
    kmers = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []
    seen, out = {}, []
    for kmer in kmers:
        seen[kmer] = seen.get(kmer, 0) + 1
        out.append((kmer, seen[kmer]))
    return out


def test_against_plain_selection(spark):
    """The pairs that each sketch keeps, worked out row by row from the same hashes."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 200, 400)]
    got = signatures(spark, texts)
    for i, text in enumerate(texts):
        words = text.split()
        pairs = numbered(words)
        if not pairs:
            assert got[i] == []
            continue
        k = O.K if len(words) >= O.K else len(words)
        rows = spark.createDataFrame([(p, [w for w in kmer], occ) for p, (kmer, occ) in enumerate(pairs)], "p int, w array<string>, occ int")
        each = F.transform("w", lambda w: F.xxhash64(w))
        h = F.xxhash64("w") if len(words) < O.K else F.xxhash64(*(each[j] for j in range(k)))
        hashed = rows.select("p", F.xxhash64(F.shiftright(h, 30), "occ").alias("v")).collect()
        bins = {}
        for r in hashed:
            bins.setdefault((r.v >> 59) & 31, []).append((r.v >> 30, r.p))
        chosen = {b: [v & ((1 << 29) - 1) for v, p in sorted(sorted(x)[: O.TUPLE], key=lambda t: t[1])] for b, x in bins.items()}
        tuples = spark.createDataFrame([(b, (v + [None] * O.TUPLE)[: O.TUPLE]) for b, v in chosen.items()], "b long, v array<bigint>")
        want = tuples.select((F.col("b") * (1 << 27) + F.pmod(F.xxhash64(*(F.col("v")[j] for j in range(O.TUPLE))), F.lit(1 << 27))).alias("s")).collect()
        assert sorted(got[i]) == sorted(r.s for r in want)


def test_edits_follow_the_next_document(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 10**6), "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40)))) for _ in range(200)] + [(None, "nobody"), (10**12, "far away"), (-5, None)]
    rows = list(dict(rows).items())
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    for width in (4, 2048):
        got = {r.doc_id: r for r in O.fingerprint_with_edits(df, width).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        assert len(got) == len(order)
        for k, (i, text) in enumerate(order):
            text, following = text or "", order[(k + 1) % len(order)][1] or ""
            n = len(text) // 3
            edited = text[: len(text) - n] + following[:n]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert O.fingerprint_with_edits(df.limit(0)).count() == 0
    one = O.fingerprint_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
