"""Per-page documents in packed files: many documents a file, in stem order, with an index.

A directory or a file for each page would be millions of them; here a job writes a few large
files and an index tells where each document lies.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("html", "text", "deals")


def content_documents(contents: DataFrame, keys: DataFrame) -> DataFrame:
    """(output_stem, kind, seq, text) of cleaned pages (page_id, cleaned_html, cleaned_text).

    ``keys`` is (page_id, output_stem).  Both documents of a page come from one row, so pages
    are read and cleaned once.
    """
    documents = F.array(
        F.struct(F.lit("html").alias("kind"), F.col("cleaned_html").alias("text")),
        F.struct(F.lit("text").alias("kind"), F.col("cleaned_text").alias("text")))
    return contents.join(keys, "page_id").select(
        "output_stem", F.explode(documents).alias("d")).select(
        "output_stem", "d.kind", F.lit(0).cast("bigint").alias("seq"), "d.text").where(
        F.col("text").isNotNull())


def report_documents(fragments: DataFrame, keys: DataFrame) -> DataFrame:
    """(output_stem, kind, seq, text) of report fragments (page_id, seq, text)."""
    return fragments.join(keys, "page_id").select(
        "output_stem", F.lit("deals").alias("kind"), "seq", "text")


def write_packed(documents: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Documents under ``files/`` in (stem, kind, seq) order, and their places under ``index/``.

    One job writes all kinds.  A document may continue in the next file; the index has a row
    (output_stem, kind, file, first_row, rows, bytes) for each file that holds some of it.  It
    is made from the narrow columns of what was written.
    """
    order = ["output_stem", "kind", "seq"]
    documents.select(*order, "text", F.octet_length("text").cast("bigint").alias("bytes")).repartitionByRange(
        *order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{folder}/files")
    stored = documents.sparkSession.read.parquet(f"{folder}/files")
    stored.select(
        "output_stem", "kind", "bytes", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row")
    ).groupBy("output_stem", "kind", "file").agg(
        F.min("row").alias("first_row"), F.count("*").alias("rows"), F.sum("bytes").alias("bytes")
    ).repartitionByRange("output_stem").sortWithinPartitions("output_stem").write.mode(mode).parquet(
        f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_document(spark: SparkSession, folder: str, stem: str, kind: str) -> DataFrame:
    """(seq, text) of one document in order; only the files that hold it are opened."""
    wanted = (F.col("output_stem") == stem) & (F.col("kind") == kind)
    files = [row.file for row in read_index(spark, folder).where(wanted).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "seq bigint, text string")
    return spark.read.parquet(*[f"{folder}/files/{name}" for name in files]).where(wanted).select(
        "seq", "text").orderBy("seq")
