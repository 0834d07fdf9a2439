"""Page-level results: counts, overall confidence, reports, gates and run metrics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions import values as V
from offerlode.functions.text import strip_space
from offerlode.operators.dedup import keyed_offers, with_rank
from offerlode.operators.dom import tokenize
from offerlode.operators.routing import Routes, extract_all, route


def page_counts(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates per page, pages without any included."""
    counts = candidates.groupBy("page_id").agg(F.count("*").alias("candidate_count"))
    return pages.select("page_id").join(counts, "page_id", "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("bigint"))


def _page_scores(candidates: DataFrame, count: int = V.TOP_FOR_PAGE_CONFIDENCE) -> DataFrame:
    """(page_id, candidate_count, _units, _best): rows of a page and its ``count`` best scores.

    Rows of one score are alike here, so a partial aggregate reduces them to a number.  A score
    is a sum of fixed points, so a page has few, and only those are put in order.
    """
    scores = candidates.groupBy("page_id", "confidence").agg(F.count("*").alias("_rows"))
    better = Window.partitionBy("page_id").orderBy(F.col("confidence").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    room = F.lit(count) - F.coalesce(F.sum("_rows").over(better), F.lit(0))
    taken = scores.withColumn("_taken", F.greatest(F.lit(0), F.least("_rows", room)))
    return taken.groupBy("page_id").agg(
        F.sum("_rows").alias("candidate_count"),
        F.sum(F.when(F.col("_taken") > 0, F.col("_taken") * S.confidence_units(
            F.col("confidence")))).alias("_units"),
        F.sum("_taken").alias("_best"))


def page_confidence(candidates: DataFrame) -> DataFrame:
    """Mean confidence of the five best candidates of each page that has any."""
    return _page_scores(candidates).select(
        "page_id",
        S.mean_confidence(F.col("_units"), F.col("_best")).alias("overall_confidence"))


def page_summaries(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page columns, candidate_count, overall_confidence); empty pages score 0.

    ``candidates`` is read once, and of it no more than page and confidence.
    """
    return _join_pages(pages, _page_scores(candidates)).withColumns({
        "candidate_count": F.coalesce("candidate_count", F.lit(0)).cast("bigint"),
        "overall_confidence": F.coalesce(
            S.mean_confidence(F.col("_units"), F.col("_best")), F.lit(0.0)),
    }).drop("_units", "_best")


def _join_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with what was found on them, if anything; a page without id has nothing.

    The condition leaves null ids of ``found`` alone: a filter on them would be pushed below the
    shuffle of the offers, which the other readers of those offers then couldn't share.
    """
    named = found.withColumnRenamed("page_id", "_found_id")
    on = pages["page_id"].eqNullSafe(named["_found_id"]) & pages["page_id"].isNotNull()
    return pages.join(named, on, "left").drop("_found_id")


def record_struct() -> Column:
    """The 15 output fields of a candidate, confidence rounded."""
    return F.struct(*[
        F.round("confidence", 3).alias(name) if name == "confidence" else F.col(name)
        for name in V.RECORD_FIELDS
    ])


REPORT_CHUNK = 1000


def page_reports(summaries: DataFrame, candidates: DataFrame,
                 chunk: int = REPORT_CHUNK) -> DataFrame:
    """Ranked candidate lists, at most ``chunk`` per row, so that no row is unbounded.

    Nearly every page fits chunk 0; a larger one continues in further rows.
    """
    ranked = with_rank(candidates)
    lists = ranked.groupBy(
        "page_id", F.floor((F.col("rank") - 1) / chunk).cast("bigint").alias("chunk")
    ).agg(F.array_sort(F.collect_list(
        F.struct("rank", record_struct().alias("candidate")))).alias("_list"))
    return _join_pages(summaries, lists).withColumns({
        "chunk": F.coalesce("chunk", F.lit(0).cast("bigint")),
        "candidates": F.coalesce(
            F.transform("_list", lambda item: item["candidate"]), F.array()),
    }).drop("_list")


def legacy_report(pages: DataFrame, routes: Routes) -> DataFrame:
    """(page_id, overall_confidence, chunk, candidates) straight from the extractors' candidates.

    No deduplication across spellings and no confidence filter follows; the mean is that of the
    five best.  Kept for callers of the older interface.
    """
    found = extract_all(route(pages, routes), routes, _tokenized)
    return page_reports(page_summaries(pages.select("page_id"), found), found).drop("candidate_count")


def _tokenized(pages: DataFrame) -> DataFrame:
    return tokenize(pages.where(F.btrim("html") != ""))


def needs_fallback(threshold: float = V.FALLBACK_THRESHOLD) -> Column:
    return F.col("overall_confidence") < min(1.0, max(0.0, threshold))


def fallback_prompts(summaries: DataFrame, text: str = "cleaned_text",
                     threshold: float = V.FALLBACK_THRESHOLD) -> DataFrame:
    """Prompt per page below the threshold; pages without text cannot be asked about."""
    body = strip_space(F.col(text))
    return summaries.where(needs_fallback(threshold) & (body != "")).select(
        "page_id", "overall_confidence",
        F.concat(F.lit(V.FALLBACK_PROMPT_PREFIX), body).alias("prompt_text"))


def with_fallback_results(summaries: DataFrame, responses: DataFrame,
                          threshold: float = V.FALLBACK_THRESHOLD) -> DataFrame:
    """Attach (page_id, response_text, response_error); candidates stay untouched."""
    asked = needs_fallback(threshold)
    joined = summaries.join(responses, "page_id", "left")
    answer = F.when(asked, F.nullif(strip_space(F.col("response_text")), F.lit("")))
    return joined.withColumns({
        "used_llm_fallback": answer.isNotNull(),
        "fallback_response_text": answer,
        "fallback_error": F.when(asked & answer.isNull(), F.col("response_error")),
    }).drop("response_text", "response_error")


# --- run metrics ------------------------------------------------------------------

def candidate_totals(candidates: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """One row: candidates before and after deduplication and the retained scores.

    Two hash aggregates on spread keys; confidences are whole hundredths and add up as
    integers, so the result does not depend on the partitioning.
    """
    keyed = keyed_offers(candidates.select(
        "page_id", "offer", "normalized_line", "discount_percent", "discount_amount",
        "confidence"))
    text_key = S.same_text_key(
        S.best_offer_text(F.col("offer"), F.col("normalized_line")))
    texts = keyed.groupBy("page_id", "offer_key", text_key.alias("text_key")).agg(
        F.max("confidence").alias("confidence"))
    offers = texts.groupBy("page_id", "offer_key").agg(
        F.count("*").alias("texts"), F.max("confidence").alias("confidence"))
    kept = F.col("confidence") >= min_confidence
    return offers.agg(
        F.coalesce(F.sum("texts"), F.lit(0)).cast("bigint").alias("total_candidates_extracted"),
        F.count("*").alias("total_after_dedup"),
        F.count_if(kept).alias("retained"),
        F.coalesce(F.sum(F.when(kept, F.round(F.col("confidence") * 100).cast("bigint"))),
                   F.lit(0)).cast("bigint").alias("retained_hundredths"),
    )


def fetch_totals(fetches: DataFrame) -> DataFrame:
    """One row from a fetch log (attempts, error)."""
    failed = F.col("error").isNotNull()
    return fetches.agg(
        F.count("*").alias("urls_processed"),
        F.count_if(~failed).alias("urls_succeeded"),
        F.count_if(failed).alias("urls_failed"),
        F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).cast("bigint").alias("total_retries"),
    )


def run_metrics(fetches: DataFrame, candidates: DataFrame,
                min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """The nine-field metrics row of a run; joins two one-row aggregates."""
    both = fetch_totals(fetches).join(candidate_totals(candidates, min_confidence), F.lit(True))
    extracted, after = F.col("total_candidates_extracted"), F.col("total_after_dedup")
    processed = F.col("urls_processed")
    return both.select(
        "urls_processed", "urls_succeeded", "urls_failed", "total_retries",
        F.when(processed == 0, F.lit(0.0)).otherwise(
            S.round_digits(F.col("total_retries") / processed, 2)).alias("retry_rate"),
        "total_candidates_extracted", "total_after_dedup",
        F.when(extracted == 0, F.lit(0.0)).otherwise(
            S.round_digits((extracted - after) / extracted * 100, 1)).alias("dedup_reduction_pct"),
        F.when(F.col("retained") == 0, F.lit(0.0)).otherwise(
            S.round_digits(F.col("retained_hundredths") / F.col("retained") / 100, 3)
        ).alias("avg_confidence"),
    )
