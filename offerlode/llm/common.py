"""What the operators share: inputs, tables in the shared folder, row digests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def configured_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master, where there is one machine, may do without the setting; a folder of
    its own is made once for the session then.
    """
    folder = configured_dir(spark)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="offerlode-")


def durable(frame: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: its lineage ends there, and a
    lost executor costs only the tasks it ran."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    kept = frame.sparkSession.read.schema(frame.schema).parquet(path)
    kept.durable_path = path
    return kept


def forget(frame: DataFrame) -> None:
    """Delete a table made by durable() that nothing reads any more."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def newest_version(spark: SparkSession, path: str) -> int | None:
    """Highest N of the finished folders path/version=N, null if there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    return max((int(one.getPath().getParent().getName().split("=")[1]) for one in found), default=None)


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame doesn't use yet."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def small(batches, rows: int = 256):
    """The same rows in smaller batches, so that a worker holds few whole texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release_memory() -> None:
    """Give back what earlier tasks of this worker freed; to be called before large caches fill."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def same(left: Column, right: Column) -> Column:
    """Equality under which null meets null; it still joins by hash."""
    return left.eqNullSafe(right)


def text_digest(text: Column) -> Column:
    """128 bits of a text as a string; null and the empty text differ."""
    return F.md5(text)
