"""Parquet tables of one folder, read without registering global views."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.plans.fixture_lines import LINES_SQL, PAGE_URL_SQL
from offerlode.session import compiled


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Deal rows out to all cores where the scan has fewer splits than there are cores.

    Small single-file tables would otherwise run their per-line work in one task.  Large
    tables have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if (df if scan is None else scan).rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def offer_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, page_id, line): the derived offer lines of ``folder``."""
    return compiled(spark).sql(
        LINES_SQL.replace("from lineitem join part", "from {lineitem} join {part}"),
        lineitem=spread(table(spark, folder, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_discount", "l_tax")),
        part=table(spark, folder, "part"),
    )


def page_url(page_id: str = "page_id"):
    return F.expr(PAGE_URL_SQL.replace("page_id", page_id))
