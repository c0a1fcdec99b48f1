"""Written intermediate tables in the folder that all executors share.

A cluster names that folder in ``spark.checkpoint.dir``; only where the setting is absent (tests, one machine)
a folder of this process is used.  A written table cuts the lineage and outlives any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local = _local or tempfile.mkdtemp(prefix="slotweave-")
    return f"file://{_local}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/slotweave/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of it; the column types stay as they are."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file by one rename: a reader sees the old text or the new one, never a part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, staged = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    out = staged.getFileSystem(conf).create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(staged, target, overwrite)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is no such file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())  # one small file


def release(spark: SparkSession) -> int:
    """Delete every intermediate table that this process has written; frames that read them end with it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
