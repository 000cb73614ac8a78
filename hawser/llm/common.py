"""What the operators of this subpackage share: reading tables, cutting lineage, sizing broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size stays under this.
BROADCAST_LIMIT_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir of the session.

    Where none is set, a local session (tests) gets a temporary folder of its own; a cluster session is refused,
    as a folder of one machine would not be seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="hawser-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For loops: a checkpoint keeps the estimated size of its plan, a join multiplies the sizes of its sides, and after
    some twenty rounds of joining a table to itself that number alone takes minutes to work out. A table has its own.
    """
    spark, folder = df.sparkSession, f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def delete(df: DataFrame) -> None:
    """Delete the files of a table that `written` has read back and nothing needs any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def checked_broadcast(small: DataFrame, n_bytes: int | None, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """`small` with a broadcast hint when its measured bytes stay under the limit, else as it is (a shuffled join)."""
    return F.broadcast(small) if (n_bytes or 0) <= limit else small
