import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from hawser.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    "", None, "a@b.c_d@e.f", "a@b..c a@b.c.", "x.@y.z.@w", "a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "+1 (743) 555-3824", "+1((((", "+12345678901234567890",
    "4111111111111111\n+44 20 7946 0958", "é@b.c ü4111 1111 1111 1111", "\ue001a@b\ue001c.d 4111\ue0011111 1111 1111 1", "9" * 5000 + "@", "1 " * 20000, "a." * 5000 + "@b.c", "a@" + "b." * 5000 + "c",
]


def test_base_spans_equal_plain_scan(spark):
    rng = random.Random(4)
    parts = ["a", "1", "4111 1111 1111 1111", ".", "@", "-", " ", "+", "(", ")", "b.c", "255", "1.2.3.4", "_", "%", "é", "\n", "5500-0000-0000-0004"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [pii._written(pii.base_spans(F.coalesce("text", F.lit("")), k)) for k in pii.KINDS]
    got = {r.doc_id: r.s for r in df.select("doc_id", F.concat_ws(",", *(F.when(s != "", s) for s in spans)).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), repr(t)[:200]


def corpus():
    """An entity whose neighbours give it away in three contexts, one that they don't, and documents without any."""
    rows = [(i, f"note {i} secretword writes from 10.1.2.3 about trip {i}", "x") for i in range(6)]
    rows += [(100 + i, f"common filler text number {i} without anything", "x") for i in range(60)]
    rows += [(200 + i, f"common filler near 10.9.9.{i} once", "x") for i in range(3)]
    return rows + [(None, "mail a@b.cd now", "x"), (300, None, "x"), (301, "", "x"), (0, rows[0][1], "x")]


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, spans string")
    got = pii.find_spans(docs).select("doc_id", pii._written(F.col("base")).alias("base"), pii._written(F.col("spans")).alias("all")).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is not None and r.doc_id < 6:
            assert "term:7:17" in r.all and r.base.startswith("ip:") and r.all.startswith(r.base)
        if r.doc_id is not None and r.doc_id >= 100:
            assert "term" not in r.all
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "secretword" not in clean[1] and "[IP]" in clean[1] and "10.1.2.3" not in clean[1]
    assert clean[100] == corpus()[6][1] and clean[300] is None and clean[301] == ""
    assert clean[None] == "mail [EMAIL] now"
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()


def test_disclosed_share(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, x string")
    found = pii._with_base(docs.select("doc_id", "text")).withColumn("_row", F.monotonically_increasing_id())
    told, _ = pii.disclosure(docs, found)
    shares = {(r.entity, r.term): r.disclosed for r in told.collect()}
    # every document with the word holds the entity: all of its information
    assert shares["ip:10.1.2.3", "secretword"] == 1.0
    assert not any(e.startswith("ip:10.9") for e, _ in shares)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.find_spans(docs).count() == 0 and pii.sanitise(docs).count() == 0


def test_query_digest(spark, small):
    rows = {r.doc_id: r for r in pii.op2_information_theoretic_pii(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        base = plain(r.text)
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[r.doc_id].spans.startswith(base)
        assert rows[r.doc_id].n_ip == base.count("ip:") and rows[r.doc_id].n_email == base.count("email:")


def plain_told(texts, least=pii.GENERALISE):
    """(entity, term) -> sure, by counting over all texts."""
    import math
    from collections import defaultdict

    words = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    n_term, n_entity, both, evidence, context = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(set), {}
    for row, text in enumerate(texts):
        text = text or ""
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in plain(text).split(",") if x)]
        outside = text
        for _, a, b in spans:
            outside = outside[:a] + " " * (b - a) + outside[b:]
        for w in words(outside):
            n_term[w] += 1
        values = {f"{k}:{text[a:b].lower()}" for k, a, b in spans}
        for e in values | {k for k, _, _ in spans}:
            n_entity[e] += 1
        for kind in {k for k, _, _ in spans}:
            for w in words(outside):
                both[kind, w].add(row)
                evidence[kind, w].add(min(v for v in values if v.startswith(kind + ":")))
        for k, a, b in spans:
            first, last = max(0, a - pii.CONTEXT), min(len(text), b + pii.CONTEXT)
            before, after = outside[first:a], outside[b:last]
            before = re.sub(r"^[^\W_]+", "", before) if first else before
            after = re.sub(r"[^\W_]+$", "", after) if last < len(text) else after
            for w in words(before) | words(after):
                both[f"{k}:{text[a:b].lower()}", w].add(row)
                e = f"{k}:{text[a:b].lower()}", w
                h = xxhash.xxh64_intdigest(after.encode(), xxhash.xxh64_intdigest(before.encode(), 42))
                context[e, row] = min(context.get((e, row), h - (1 << 64) if h >> 63 else h), h - (1 << 64) if h >> 63 else h)
    for (e, _), h in context.items():  # one context a text
        evidence[e].add(h)
    out = {}
    for (e, w), rows in both.items():
        own = n_entity[e] / len(texts)
        if len(evidence[e, w]) > 1 and own < 1:
            sure = 1 + math.log2(min(1, (len(rows) + pii.PRIOR * own) / (n_term[w] + pii.PRIOR))) / -math.log2(own)
            if sure >= least:
                out[e, w] = sure
    return out


def test_told_terms_against_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([r[:2] for r in corpus()], docs.schema))
    found = pii._with_base(docs).withColumn("_row", F.monotonically_increasing_id()).cache()
    told, _ = pii.disclosure(docs, found, 0.7)
    got = {(r.entity, r.term): round(r.sure, 9) for r in told.collect()}
    want = {k: round(v, 9) for k, v in plain_told([r.text for r in docs.collect()], 0.7).items()}
    assert got == want and len(want) > 5


def test_terms_are_marked_wherever_they_stand(spark):
    rows = corpus() + [(400, "Secretword alone, and SECRETWORD2 not", "x"), (401, "10.1.2.3secretword 10.1.2.3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[400] == "[NAME] alone, and SECRETWORD2 not" and clean[401] == "[IP][WORD] [IP]"


def test_overlapping_spans_and_odd_rows_are_rewritten_once(spark):
    rows = [(1, "a1.2.3.4@b.cd +10.20.30.40 é😀 5500-0000-0000-0004!", None), (None, None, 3), (None, None, 3), (2, "", 7)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_chars long, _row string")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    assert sorted(out, key=str) == sorted([(1, t := "[EMAIL] [PHONE] é😀 [CARD]!", len(t), "c"), (None, None, 3, "c"), (None, None, 3, "c"), (2, "", 7, "c")], key=str)


def test_very_many_spans_in_one_text(spark):
    import time

    texts = [" ".join(f"{i % 97}" for i in range(1_500_000)), " ".join(f"u{i}@b.cd é" for i in range(60_000)), "4111 1111 1111 1111, " * 60_000, "1.2.3.4 " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (len(r.base), r.text) for r in pii.find_spans(docs).join(pii.sanitise(docs), "doc_id").collect()}
    assert time.time() - began < 240
    assert [got[i][0] for i in range(4)] == [0, 60_000, 60_000, 60_000]
    assert got[0][1] == texts[0] and got[1][1] == "[EMAIL] é " * 59_999 + "[EMAIL] é" and got[3][1] == "[IP] " * 60_000
