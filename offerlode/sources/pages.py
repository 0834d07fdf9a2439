"""Page, text and raw-file sources."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.text import page_title
from offerlode.functions.urls import normalized_url, url_error
from offerlode.operators import dom


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) as fetched-page records without cleaned content yet."""
    nothing = F.lit(None)
    present = set(pages.columns)
    return pages.select(
        "page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"),
        page_title(F.col("html")).alias("title"), F.col("html").alias("raw_html"),
        *[(F.col(name) if name in present else nothing.cast("int").alias(name))
          for name in ("status_code", "elapsed_ms")])


def page_contents(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) as whole page records: the eight fields of a fetched page."""
    present = set(pages.columns)
    kept = ["page_id", "url", "html", *[n for n in ("status_code", "elapsed_ms") if n in present]]
    tokens = dom.tokenize(pages.select(*kept))
    return tokens.select(
        "page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"),
        page_title(F.col("html")).alias("title"), F.col("html").alias("raw_html"),
        dom.cleaned_html().alias("cleaned_html"), dom.cleaned_text().alias("cleaned_text"),
        *[(F.col(name) if name in present else F.lit(None).cast("int")).alias(name)
          for name in ("status_code", "elapsed_ms")])


def page_error(url: Column, root_dropped: Column, html: Column,
               parse_error: Column | None = None) -> Column:
    """Why a page gives no report: a bad URL, nothing left to serialise, or no parse."""
    empty = (F.coalesce(F.btrim(html), F.lit("")) == "") | root_dropped
    return F.coalesce(
        url_error(url),
        F.when(empty, F.concat(F.lit(V.EMPTY_PAGE_PREFIX), normalized_url(url), F.lit("."))),
        F.lit(None) if parse_error is None else parse_error)


#: Names of the encodings that the JVM decodes here; all others go to Python's codecs.
UTF8_NAMES = ("utf-8", "utf8", "utf_8")


def _other_encoding(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
    def text(data: bytes | None, name: str) -> str:
        try:
            return bytes(data or b"").decode(name, errors="replace")
        except (LookupError, ValueError):  # an unknown name is read as UTF-8
            return bytes(data or b"").decode("utf-8", errors="replace")

    return pd.Series([text(data, name) if name else None for data, name in zip(bodies, encodings)])


_other_encoding.__module__ = "__main__"  # pickled by value: executors need no copy of this file


def decode_body(body: Column, encoding: Column) -> Column:
    """Bytes to text, malformed input replaced, as the declared encoding or UTF-8.

    UTF-8 and pure ASCII bytes stay in the JVM; only bodies that declare another encoding are
    decoded by Python.  Null bodies give the empty text, unknown encodings are read as UTF-8.
    """
    data = F.coalesce(body, F.unhex(F.lit("")))
    name = F.lower(F.trim(F.coalesce(encoding, F.lit(""))))
    native = (name == "") | name.isin(*UTF8_NAMES)
    other = F.pandas_udf(_other_encoding, "string")(
        F.when(~native, data), F.when(~native, name))
    return F.when(native, F.make_valid_utf8(data.cast("string"))).otherwise(other)


def read_page_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Stored HTML files as (url, html); the file path stands for the URL."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("url"),
        decode_body(F.col("content"), F.lit(encoding)).alias("html"))


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (url, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("url"), F.col("value").alias("text"))
