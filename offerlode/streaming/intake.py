"""Incremental page intake: new page files through the same plan as a batch.

Deduplication is per page and a page is one row, so micro-batches share no state.  What runs
across them, the totals of a run, is a streaming aggregate over the summaries they leave.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

PAGE_SCHEMA = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, path: str, schema: str | StructType = PAGE_SCHEMA,
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start_intake(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str,
                 checkpoint: str) -> StreamingQuery:
    """Append the plan's result for each micro-batch under ``path``.

    Every batch writes its own folder.  Replayed after a failure, a batch that was written
    whole is left as it is and one that was not is written anew, so each page is there once
    and no reader sees a finished batch change. ``checkpoint`` is a shared folder of this
    stream alone; it has to outlive the stream, or batches would be numbered from 0 again.
    """
    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path}/batch={number}"
        if not _is_complete(batch.sparkSession, folder):
            plan(batch).write.mode("overwrite").parquet(folder)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_totals(summaries: DataFrame) -> DataFrame:
    """Rows, candidates and confidence of each status, over a stream or table of summaries.

    Confidences have two digits and are added as whole hundredths, so the sums do not depend
    on how pages were dealt to micro-batches.
    """
    return summaries.groupBy("status").agg(
        F.count("*").alias("pages"),
        F.sum(F.coalesce("candidate_count", F.lit(0))).cast("bigint").alias("candidates"),
        F.sum(F.coalesce(F.round(F.col("overall_confidence") * 100), F.lit(0.0)).cast("bigint"))
        .alias("confidence_hundredths"))


def start_totals(spark: SparkSession, path: str, schema: str | StructType, target: str,
                 checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Keep the totals of the summaries under ``path`` as a small table at ``target``.

    To be run between intakes, as they leave their batches.  The running sums are checkpointed state: a restart goes on from the last finished
    micro-batch and reads only new files.  Each micro-batch replaces the table of its own
    number, so a replay changes nothing; ``read_totals`` reads the newest.
    """
    def write(totals: DataFrame, number: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{target}/version={number}")

    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    summaries = reader.parquet(f"{path}/batch=*")
    return (run_totals(summaries).writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_totals(spark: SparkSession, target: str) -> DataFrame:
    """The newest totals, empty before the first micro-batch has ended."""
    versions = spark.read.parquet(target)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")
