"""Inventory documents, file listings, metadata files, archives and hash files."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("destination", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()),
        T.StructField("archive_toc", T.ArrayType(T.StringType())), T.StructField("suitcase_index", T.IntegerType()), T.StructField("suitcase_name", T.StringType()),
    ]
)
INVENTORY = T.StructType(
    [
        T.StructField("files", T.ArrayType(FILE)), T.StructField("total_indexes", T.IntegerType()), T.StructField("internal_metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("external_metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt", T.StringType()),
    ]
)

_ZSTD = b"\x28\xb5\x2f\xfd"  # fixed value: how a zstd frame begins


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a folder: path, name, size, modified. Their content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def metadata_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of text files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_inventories(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """One row per inventory document below `path`: INVENTORY and inventory_path. Documents that can't be read come with
    _corrupt set instead of failing the job. JSON is read by Spark; YAML (if PyYAML is there) is turned into it.
    """
    if fmt == "json":
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
        parsed = raw.select(F.col("_metadata.file_path").alias("inventory_path"), F.from_json("value", INVENTORY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
        return parsed.select("d.*", "inventory_path")
    if fmt not in ("yaml", "yml"):
        raise ValueError(f"no inventory reader for {fmt}")

    @F.pandas_udf(T.StringType())
    def as_json(texts: pd.Series) -> pd.Series:
        import yaml

        def convert(text: str) -> str | None:
            try:
                return json.dumps(yaml.safe_load(text), default=str)
            except yaml.YAMLError:
                return None

        return texts.map(convert)

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("inventory_path"), "value")
    parsed = raw.withColumn("j", as_json("value")).withColumn("d", F.from_json("j", T.StructType(INVENTORY.fields[:-1])))
    return parsed.select("d.*", F.when(F.col("j").isNull() | F.col("d.files").isNull(), F.col("value")).alias("_corrupt"), "inventory_path")


def inventory_files(inventories: DataFrame) -> DataFrame:
    return inventories.where("_corrupt is null").select("inventory_path", F.explode("files").alias("f")).select("inventory_path", "f.*")


def inventory_json(files: DataFrame) -> DataFrame:
    """One JSON document per file row, as written to an inventory."""
    return files.select(F.to_json(F.struct(*files.columns), {"ignoreNullFields": "false"}).alias("value"))


def members(content: bytes) -> list[str] | None:
    """Paths of the files in a tar (plain, gz, bz2, xz, zst) or zip, sorted; none for anything else, null for an archive
    that is broken or cut off."""
    try:
        source = io.BytesIO(content)
        if content[:4] == _ZSTD:
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(source) as plain, tarfile.open(fileobj=plain, mode="r|") as t:
                return sorted(m.name for m in t if m.isfile())
        if zipfile.is_zipfile(source):
            with zipfile.ZipFile(source) as z:
                return sorted(n for n in z.namelist() if not n.endswith("/"))
        source.seek(0)
        with tarfile.open(fileobj=source) as t:
            return sorted(m.name for m in t if m.isfile())
    except tarfile.ReadError as problem:
        signs = ("unexpected end", "truncated", "empty") if content[:4] == _ZSTD else ("unexpected end",)
        return None if any(sign in str(problem) for sign in signs) else []
    except Exception:  # decompressors raise errors of their own kinds (EOFError, zlib.error, OSError, LZMAError, ZstdError)
        return None


def archive_tocs(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, toc): sorted member paths of each archive; an empty list for what is no archive, null for a broken one."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def listed(contents: pd.Series) -> pd.Series:
        return pd.Series([members(c) if c is not None else [] for c in contents], dtype=object)

    return archives.select(key, listed(content).alias("toc"))


def build_archives(files: DataFrame, fmt: str = "tar.gz") -> DataFrame:
    """One archive per bin of files (suitcase_index, destination, content): suitcase_index, members, content, sha256.

    A bin is a task's group; its size is bound by the cap it was packed with. Members are written by destination.
    """
    packers = {"tar": lambda b: b, "tar.gz": lambda b: gzip.compress(b, mtime=0), "tar.bz2": bz2.compress, "tar.zst": _zstd}
    if fmt not in packers:
        raise ValueError(f"no archive writer for {fmt}")
    pack = packers[fmt]

    def write(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in sorted(zip(group["destination"], group["content"], strict=True)):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        data = pack(out.getvalue())
        return pd.DataFrame([(group["suitcase_index"].iloc[0], len(group), data, hashlib.sha256(data).hexdigest())], columns=["suitcase_index", "members", "content", "sha256"])

    return files.groupBy("suitcase_index").applyInPandas(write, "suitcase_index long, members long, content binary, sha256 string")


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data)


def hash_lines(hashes: DataFrame, binary: bool = False) -> DataFrame:
    """`hash<TAB>filename` lines; binary gives the digest in base64."""
    digest = F.base64(F.unhex("hash")) if binary else F.col("hash")
    return hashes.select(F.concat(digest, F.lit("\t"), "filename").alias("value"))


def metric_batches(metrics: DataFrame, shard: str, size: int = 20) -> DataFrame:
    """`metrics` with batch: rows of a shard in groups of `size`, by name and time, as a publisher sends them."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(shard).orderBy("name", "ts"))
    return metrics.withColumn("batch", F.ceil(n / size).cast("long"))


def to_pandas_batches(rows: DataFrame, send) -> None:
    """Hand each partition's rows to `send(iterator of pandas frames)` on the executors; the transporter seam."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send(batches)
        yield pd.DataFrame({"done": [1]})

    rows.mapInPandas(each, "done int").write.format("noop").mode("overwrite").save()
