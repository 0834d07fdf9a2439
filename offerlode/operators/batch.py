"""Batch results: one row per requested URL, and their totals."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions import values as V
from offerlode.functions.text import page_title
from offerlode.functions.urls import normalized_url, output_stem, url_error
from offerlode.operators import dom, report
from offerlode.operators.dedup import deduplicate, rank_and_filter, top_offers
from offerlode.operators.routing import Routes, candidates_of, page_rows, route, rows_where


@dataclass(frozen=True)
class Batch:
    """What one pass over the pages gives: a record for each page, and its offers."""

    records: DataFrame
    candidates: DataFrame

    def offers(self, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
        return rank_and_filter(deduplicate(self.candidates), min_confidence)


def page_outcome(url: Column) -> Column:
    """Why a tokenised page gives no report: nothing left to serialise, or no parse."""
    empty = (F.coalesce(F.btrim("html"), F.lit("")) == "") | F.col("root_dropped")
    return F.coalesce(
        F.col("error"),
        F.when(empty, F.concat(F.lit(V.EMPTY_PAGE_PREFIX), normalized_url(url), F.lit("."))))


def run_batch(pages: DataFrame, routes: Routes, contents: bool = False) -> Batch:
    """Records and candidates of fetched pages (page_id, url, html) from one scan of them.

    Every page is read and tokenised once.  Its record (page_id, title, error and, with
    ``contents``, cleaned_html and cleaned_text) is a row of the same generate that gives the
    lines of all extractors, so both come out of one shuffle.  ``requested_url``, where there
    is such a column, is the URL that messages name.  Pages that are blank, lose their root or
    can't be parsed have an error and no candidates.
    """
    asked = F.col("requested_url" if "requested_url" in pages.columns else "url")
    nothing = F.lit(None).cast("string")
    tokens = dom.tokenize(route(pages, routes))
    record = F.struct(
        page_title(F.col("html")).alias("title"),
        (dom.cleaned_html() if contents else nothing).alias("cleaned_html"),
        (dom.cleaned_text() if contents else nothing).alias("cleaned_text"),
        page_outcome(asked).alias("error"))
    rows = page_rows(tokens, routes, record, lines_if=page_outcome(asked).isNull())
    records = rows_where(rows, F.col("page").isNotNull()).select("page_id", "page.*")
    routed = route(pages, routes)
    return Batch(records, candidates_of(rows, routes, routed, dom.tokenize))


def summarize_batch(urls: DataFrame, batch: Batch, **options) -> DataFrame:
    """The 17 columns for requested URLs (row_number, requested_url, page_id and, where known,
    final_url, status_code, elapsed_ms) and the batch of the pages that were fetched."""
    offers = batch.offers()
    results = report.page_summaries(batch.records, offers).withColumns({
        "used_llm_fallback": F.lit(False), "fallback_error": F.lit(None).cast("string"),
    }).withColumnRenamed("error", "page_error")
    absent = {
        name: F.lit(None).cast(kind) for name, kind in (
            ("final_url", "string"), ("status_code", "int"), ("elapsed_ms", "int"))
        if name not in urls.columns}
    asked = urls.withColumns(absent).withColumn("url_error", url_error(F.col("requested_url")))
    tops = top_offers(offers).select(
        "page_id", F.col("offer").alias("top_offer"), F.col("offer_type").alias("top_offer_type"))
    joined = asked.join(results, "page_id", "left").withColumn(
        "error", F.coalesce("url_error", "page_error"))
    return _summary_rows(joined.join(tops, "page_id", "left"), **options)


def batch_summary(urls: DataFrame, results: DataFrame, tops: DataFrame,
                  folder: str = "output", extension: str = "txt",
                  save_html: bool = False) -> DataFrame:
    """Requested URLs joined to page results.

    ``urls``: row_number, requested_url, page_id, error.  ``results``: per page, final_url,
    title, status_code, elapsed_ms, overall_confidence, candidate_count and the fallback
    columns.  ``tops``: page_id, top_offer, top_offer_type.  An error row keeps only its
    number, URL and error.
    """
    return _summary_rows(urls.join(results, "page_id", "left").join(tops, "page_id", "left"),
                         folder, extension, save_html)


def _summary_rows(joined: DataFrame, folder: str = "output", extension: str = "txt",
                  save_html: bool = False) -> DataFrame:
    fine = F.col("error").isNull()
    stem = output_stem(F.col("row_number"), F.col("requested_url"))

    def path(kind: str, suffix: str) -> Column:
        return F.concat(F.lit(f"{folder}/{kind}/"), stem, F.lit(f".{suffix}"))

    values = {
        "status": F.when(fine, "ok").otherwise("error"),
        "candidate_count": F.when(fine, F.col("candidate_count")).otherwise(0),
        "used_llm_fallback": F.coalesce(
            F.when(fine, F.col("used_llm_fallback")), F.lit(False)),
        "html_path": F.when(fine, path("html", "html")) if save_html
        else F.lit(None).cast("string"),
        "text_path": F.when(fine, path("text", "txt")),
        "deals_path": F.when(fine, path("deals", extension)),
        "title": F.when(fine & (F.col("title") != ""), F.col("title")),
    }
    plain = ("row_number", "requested_url", "error")
    return joined.select(*[
        (values[name] if name in values else F.col(name) if name in plain
         else F.when(fine, F.col(name))).alias(name)
        for name in V.SUMMARY_FIELDS])


def summary_text(summary: DataFrame) -> DataFrame:
    """Summary columns as the CSV shows them: two digits, yes/no, blanks for nulls."""
    special = {
        "overall_confidence": S.two_digits(F.col("overall_confidence")),
        "used_llm_fallback": F.when(F.col("used_llm_fallback"), "yes").otherwise("no"),
    }
    return summary.select(*[
        F.coalesce(special.get(name, F.col(name).cast("string")), F.lit("")).alias(name)
        for name in V.SUMMARY_FIELDS])


def _totals() -> list[Column]:
    failed = F.col("status") == "error"
    return [F.count("*").alias("total"), F.count_if(~failed).alias("succeeded"),
            F.count_if(failed).alias("failed")]


def batch_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(*_totals())


def observed(summary: DataFrame) -> tuple[DataFrame, Observation]:
    """The summary and its totals, counted while it is written; no second pass is needed."""
    totals = Observation("batch_totals")
    return summary.observe(totals, *_totals()), totals


def run_summary(urls: DataFrame, batch: Batch) -> DataFrame:
    """The ten fields that a run reports for each page that came out well.

    ``batch`` has to hold contents, whose sizes are shown.
    """
    results = report.page_summaries(batch.records, batch.offers())
    absent = {
        name: F.lit(None).cast("int") for name in ("status_code", "elapsed_ms")
        if name not in urls.columns}
    joined = urls.withColumns(absent).where(url_error(F.col("requested_url")).isNull()).join(
        results.where(F.col("error").isNull()), "page_id")
    return joined.select(
        "page_id", "requested_url", "final_url",
        F.coalesce(F.nullif("title", F.lit("")), F.lit(V.NO_TITLE)).alias("title"),
        "status_code", F.length("cleaned_html").cast("bigint").alias("html_size"),
        F.length("cleaned_text").cast("bigint").alias("text_size"), "elapsed_ms",
        F.col("overall_confidence").alias("heuristic_confidence"),
        F.lit(False).alias("llm_fallback"), F.col("candidate_count").alias("candidates"))
