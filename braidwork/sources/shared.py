"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it on, Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch on its way to Python, and what they are for tables whose rows are large arrays.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder where it is unset and the master is local (tests), an error else."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-braidwork-")
    return _local_dir


def written(df: DataFrame, name: str, group_rows: int | None = None, large_rows: bool = False) -> DataFrame:
    """``df`` written out and read back: short lineage that outlives executors, and true sizes for the optimizer.

    The shuffle files behind it are removed, as nothing reads them again. A
    reader holds a whole row group, or thousands of its rows, at once, and a
    writer looks at its size every hundred rows only: tables whose rows are
    large arrays bound the rows of a group by ``group_rows``. Their batches on
    the way to Python are small too, as each is held outside of the heap twice;
    ``large_rows`` asks for that where only what is read has such rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({BATCH: str(BATCH_BYTES)} if group_rows or large_rows else {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned. Nothing may read them any more: what was made of them must be written itself."""
    for df in tables:
        delete(df.sparkSession, df._written_at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, for readers that do not know Spark's default one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store(uri: str):
    """(file system, path) for a task, of a qualified path; characters that a URI would escape are taken as they are."""
    from pyarrow import fs

    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?$", uri)
    if not m or m[1].lower() == "file":
        return fs.LocalFileSystem(), (m[3] or "/") if m else uri
    scheme = {"s3a": "s3", "s3n": "s3"}.get(m[1].lower(), m[1])
    found, root = fs.FileSystem.from_uri(f"{scheme}://{m[2] or ''}/")
    return found, root.rstrip("/") + (m[3] or "/")
