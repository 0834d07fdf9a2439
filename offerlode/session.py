"""Session settings for tests, benches and stand-alone runs."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Methods beyond 8000 bytes are never compiled to machine code; let Spark split them.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def compiled(spark: SparkSession) -> SparkSession:
    """``spark`` with a limit at which the JVM compiles every method, if it had a higher one.

    The detectors of a line fill one method of a fused stage, which the JVM would interpret.
    """
    key, limit = COMPILED
    if int(spark.conf.get(key)) > int(limit):
        spark.conf.set(key, limit)
    return spark


def build_session(cores: str = "8", app: str = "offerlode", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(*COMPILED)
        # Parsing is heavier than its rows are wide: small shuffles still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_SHARED: list[DataFrame] = []


def shared(df: DataFrame) -> DataFrame:
    """``df`` kept for the branches of a plan that all read it, until ``release_shared``.

    Lazy, in memory and on the executors' disks; the lineage stays, so what a lost executor
    held is computed again.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _SHARED.append(kept)
    return kept


def release_shared() -> None:
    """Drop what ``shared`` kept; to be called once the results that read it are written."""
    while _SHARED:
        _SHARED.pop().unpersist()


@contextmanager
def sharing() -> Iterator[None]:
    """Scope of one action: what is shared inside is dropped at its end."""
    try:
        yield
    finally:
        release_shared()
