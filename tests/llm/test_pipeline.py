import corpus_pipeline as P
from hawser.llm import decontamination, near_copies, pii, quality
from hawser.llm.common import table


def test_stages_equal_their_operators(spark, small, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "information-theoretic pii", "best-fit packing"]
    docs = table(spark, small, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
            kept.append({r.doc_id: r.text for r in after.collect()})
        docs_in, docs = docs, after
        if k == 0:
            scores = quality.score_documents(docs_in, quality.train(docs_in, table(spark, small, "labels")))
            assert set(kept[0]) == {r.doc_id for r in scores.where("predicted = 1").collect()}
        if k == 1:
            assert set(kept[1]) == {r.component_id for r in near_copies.near_copies(docs_in).collect()}
        if k == 2:
            dirty = {r.doc_id for r in decontamination.contaminated_pairs(docs_in, table(spark, small, "benchmark")).collect()}
            assert dirty and set(kept[2]) == set(kept[1]) - dirty
        if k == 3:
            spans = {r.doc_id: r.spans for r in pii.find_spans(docs_in).collect()}
            assert set(kept[3]) == set(kept[2])
            assert all((kept[3][i] == before[i]) == (not spans[i]) for i in kept[3])
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept[0] for i in good) > 0.9 * len(good)  # some fifty labels to learn from here


def test_run(spark, small):
    assert P.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert P.ORACLE_SQL is None


def test_stages_with_nulls_copies_clashing_names_and_empty_tables(spark, small, tmp_path):
    docs = table(spark, small, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, "en", None, 4), (10**9, None, "en", None, 4), (10**9 + 1, "", None, "s", None), (10**9 + 2, "word " * 200_000, "en", "s", 1)], docs.schema)
    extra = docs.union(odd).selectExpr("*", "1 AS score", "'n' AS node", "2 AS _row", "'p' AS piece", "3 AS sequence_id")
    for given in (extra, extra.limit(0)):
        out = given
        for name, stage in P.STAGES[:4]:
            columns = out.columns
            stage(spark, out, small).write.parquet(str(tmp_path / f"{name} {given is extra}"))
            out = spark.read.parquet(str(tmp_path / f"{name} {given is extra}"))
            assert out.columns == columns
        packed = P.STAGES[4][1](spark, out, small).collect()
        assert bool(packed) == (given is extra)
        assert {r.doc_id for r in packed} == {r.doc_id for r in out.collect()}
