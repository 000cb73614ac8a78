import json

from hawser.sources import inventories
from hawser.streaming import streams


def test_inventories_round_trip(spark, tmp_path):
    doc = {"files": [{"path": "/x/a.txt", "destination": "a.txt", "name": "a.txt", "size": 29, "archive_toc": None, "suitcase_index": 1, "suitcase_name": "s"}], "total_indexes": 1}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{ nope")
    read = inventories.read_inventories(spark, str(tmp_path))
    assert read.where("_corrupt is not null").count() == 1
    assert [(r.destination, r.size) for r in inventories.inventory_files(read).collect()] == [("a.txt", 29)]


def test_yaml_inventories(spark, tmp_path):
    (tmp_path / "inv.yaml").write_text("files:\n  - path: /x\n    destination: x\n    name: x\n    size: 5\ntotal_indexes: 1\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    read = inventories.read_inventories(spark, str(tmp_path), "yaml")
    assert read.where("_corrupt is not null").count() == 1
    assert [(r.name, r.size) for r in inventories.inventory_files(read).collect()] == [("x", 5)]


def test_scan_and_metadata(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("hello")
    assert [(r.name, r["size"]) for r in inventories.scan_files(spark, str(tmp_path)).collect()] == [("a.txt", 5)]
    assert [r.content for r in inventories.metadata_files(spark, f"{tmp_path}/sub/*.txt").collect()] == ["hello"]


def test_archives_round_trip(spark):
    rows = [(1, "b", bytearray(b"2")), (1, "a", bytearray(b"1")), (2, "c", bytearray(b""))]
    df = spark.createDataFrame(rows, "suitcase_index long, destination string, content binary")
    for fmt in ("tar", "tar.gz", "tar.bz2"):
        got = {r.suitcase_index: r.toc for r in inventories.archive_tocs(inventories.build_archives(df, fmt), "suitcase_index").collect()}
        assert got == {1: ["a", "b"], 2: ["c"]}
    assert inventories.members(b"no archive") == []


def test_hash_lines(spark):
    df = spark.createDataFrame([("00ff", "f")], "hash string, filename string")
    assert inventories.hash_lines(df).first()[0] == "00ff\tf"
    assert inventories.hash_lines(df, binary=True).first()[0] == "AP8=\tf"


def test_congestion_steps():
    s = streams.congestion_step(streams.FSM_START, 1.0, 100.0, 10.0, 0.0)
    assert s[:3] == ("slow_start", 6, 32)
    s = streams.congestion_step(("slow_start", 30, 32, 1.0, 0.0), 2.0, 100.0, 10.0, 0.0)
    assert s[:3] == ("avoidance", 32, 32)
    s = streams.congestion_step(("avoidance", 32, 32, 1.0, 0.0), 3.0, 100.0, 10.0, 0.02)
    assert s[:3] == ("recovery", 16, 16) and s[4] == 3.0
    assert streams.congestion_step(("recovery", 16, 16, 1.0, 3.0), 10.0, 100.0, 10.0, 0.001)[0] == "recovery"
    assert streams.congestion_step(("recovery", 16, 16, 1.0, 3.0), 100.0, 100.0, 10.0, 0.001)[0] == "avoidance"
    assert streams.congestion_step(("avoidance", 20, 16, 1.0, 3.0), 100.0, 100.0, 2000.0, 0.0)[:2] == ("recovery", 5)


def test_upsert_sink(spark, small, tmp_path):
    stream = streams.events_stream(spark, small)
    streams.upsert_latest(stream.select("user_id", "ts", "value"), ["user_id"], "ts", str(tmp_path / "t")).awaitTermination()
    got = streams.latest(spark, str(tmp_path / "t"), ["user_id"], "ts")
    assert got.count() == spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()


def test_entry_imports_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_members_of_whole_and_broken_archives():
    import bz2
    import gzip
    import io
    import tarfile

    import zstandard

    from hawser.sources.inventories import members

    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as t:
        for name in ("b/two", "a/one"):
            info = tarfile.TarInfo(name)
            info.size = 5000
            t.addfile(info, io.BytesIO(b"x" * 5000))
    plain = held.getvalue()
    for whole in (plain, gzip.compress(plain), bz2.compress(plain), zstandard.compress(plain)):
        assert members(whole) == ["a/one", "b/two"]
    for broken in (gzip.compress(plain)[:-20], zstandard.compress(plain)[:20], gzip.compress(plain)[:60]):
        assert members(broken) is None
    assert members(b"") == [] and members(b"no archive at all") == []
