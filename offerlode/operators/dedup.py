"""Deduplication, ranking and top-k per page.

Windows that keep one or few rows per group are planned with a map-side group limit;
no full page is ever sorted in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.scoring import best_offer_text, same_text_key, with_canonical_key
from offerlode.functions.text import normalize_candidate_text

POSITION = ("ord_hi", "ord_lo", "offer")
#: Largest count for which Spark limits groups before the shuffle.
GROUP_LIMIT = 1_000


def best_first() -> list[Column]:
    return [F.col("confidence").desc(), *map(F.col, POSITION)]


def normalize_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({
        "offer": normalize_candidate_text(F.col("offer")),
        "normalized_line": normalize_candidate_text(F.col("normalized_line")),
    })


def keep_first(rows: DataFrame, keys: list[str], order: list[Column], count: int = 1,
               rank: str | None = None) -> DataFrame:
    """First ``count`` rows of every group."""
    numbered = rows.withColumn(
        rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col(rank or "_rank") <= count)
    return kept if rank else kept.drop("_rank")


def distinct_offers(candidates: DataFrame) -> DataFrame:
    """Same text within a page: the earlier pass, then the earlier position, wins."""
    keyed = candidates.withColumn(
        "text_key", same_text_key(best_offer_text(F.col("offer"), F.col("normalized_line"))))
    return keep_first(
        keyed, ["page_id", "text_key"], [F.col(name) for name in POSITION]).drop("text_key")


def keyed_offers(candidates: DataFrame) -> DataFrame:
    text = best_offer_text(F.col("offer"), F.col("normalized_line"))
    return with_canonical_key(candidates, "offer_key", text)


def deduplicate(candidates: DataFrame, whole: bool = False, by_page: bool = False) -> DataFrame:
    """Same canonical offer within a page: the highest confidence wins.

    ``whole`` breaks further ties by all other columns.  Then every reader needs whole rows, so
    several readers share one shuffle where else each would prune and make its own.  ``by_page``
    shuffles by page, for pages that fit a task; what follows by page needs no other shuffle.
    """
    keyed = keyed_offers(candidates)
    order = best_first()
    if whole:
        order += [F.col(name) for name in candidates.columns
                  if name not in ("page_id", "confidence", *POSITION)]
    if by_page:
        keyed = keyed.repartition("page_id")
    return keep_first(keyed, ["page_id", "offer_key"], order).drop("offer_key")


def rank_and_filter(candidates: DataFrame, min_confidence: float = V.MIN_CONFIDENCE,
                    max_results: int | None = None) -> DataFrame:
    """Drop low-quality candidates; optionally keep the best ``max_results`` per page.

    The order itself is (confidence desc, position) and needs no shuffle until someone
    asks for row numbers (``with_rank``) or a cap.
    """
    kept = candidates.where(F.col("confidence") >= min_confidence)
    if max_results is None or max_results <= 0:
        return kept
    if max_results > GROUP_LIMIT:  # no map-side limit: rank by many tasks instead
        return with_rank(kept, "_rank").where(F.col("_rank") <= max_results).drop("_rank")
    return keep_first(kept, ["page_id"], best_first(), max_results)


def top_offers(candidates: DataFrame, count: int = 1, rank: str | None = None) -> DataFrame:
    return keep_first(candidates, ["page_id"], best_first(), count, rank)


#: Pages of more offers are ranked by many tasks, in stretches between quantiles.
LARGE_PAGE = 10_000
STRETCHES = 1_000
RANK, PAGE_TOTAL = "rank", "page_total"


def _matches(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality with the columns of ``right`` called at<name>.

    Equality would filter nulls below what ``right`` is made of, which then shares no shuffle
    with other readers.
    """
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[f"at{name}"])
    return found


def split_by_size(rows: DataFrame, value: str, large_page: int = LARGE_PAGE) -> tuple[DataFrame, DataFrame]:
    """Rows of pages with at most ``large_page`` of them, and those of larger pages.

    ``rows`` come from an aggregate with one value column besides the keys; it is read here, so
    that the count shares the shuffle of the rows.  Pages above the limit are fewer than rows /
    ``large_page``, so they are broadcast.
    """
    count = F.count(value) + F.count_if(F.col(value).isNull())
    sizes = rows.groupBy(F.col("page_id").alias("atpage_id")).agg(count.alias("_rows"))
    large = F.broadcast(sizes.where(F.col("_rows") > large_page).select("atpage_id"))
    on = _matches(rows, large, ["page_id"])
    return rows.join(large, on, "left_anti"), rows.join(large, on, "left_semi")


def ranked_pages(small: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deduplicated, filtered offers, and the same with ``rank`` and ``page_total``.

    Candidates come in two parts (``split_by_size``).  A task holds whole small pages, so one
    shuffle serves their deduplication and ranks; many tasks share a large page.  Both results
    read the same shuffles.
    """
    few = rank_and_filter(deduplicate(small, whole=True, by_page=True))
    many = rank_and_filter(deduplicate(large, whole=True))
    page = Window.partitionBy("page_id")
    ranked = few.withColumns({
        RANK: F.row_number().over(page.orderBy(*best_first())).cast("bigint"),
        PAGE_TOTAL: F.count("*").over(page)})
    return few.unionByName(many), ranked.unionByName(with_rank(many, RANK, PAGE_TOTAL, large_page=0))


def _stretches(candidates: DataFrame, large: DataFrame | None, stretches: int) -> DataFrame:
    """(atpage_id, atconfidence, atord_hi, bounds): quantiles of the positions on large pages.

    The sketch is a partial aggregate of bounded size, so a page with a third of all rows is
    summed up by all tasks that hold some of it.
    """
    share = [at / stretches for at in range(1, stretches)]
    rows = candidates.select("page_id", "confidence", "ord_hi", "ord_lo")
    if large is not None:
        rows = rows.join(large, _matches(rows, large, ["page_id"]), "left_semi")
    return rows.groupBy(*[F.col(name).alias(f"at{name}") for name in ("page_id", "confidence", "ord_hi")]).agg(
        F.percentile_approx("ord_lo", share, 10 * stretches).alias("_bounds"),
        F.lit(True).alias("_split"))


def with_rank(candidates: DataFrame, rank: str = RANK, total: str | None = None,
              large_page: int = LARGE_PAGE, stretches: int = STRETCHES) -> DataFrame:
    """Exact rank of every candidate of its page, also where one page is very large.

    Rank = candidates in better buckets + row number inside the own bucket.  A page of up to
    ``large_page`` candidates is one bucket; at 0 no page is counted first.  A larger one has a
    bucket for each confidence, pass and stretch between quantiles of the positions, so it is
    sorted by many tasks and only its bucket counts meet in one.  ``total`` adds the page's number
    of candidates; it comes from the same counts.  Candidates that have their rank already
    (``ranked_pages``) keep it.
    """
    if {rank, total or rank} <= set(candidates.columns):
        return candidates
    large = None
    if large_page > 0:
        large = candidates.groupBy(F.col("page_id").alias("atpage_id")).agg(
            F.count("*").alias("_total")).where(F.col("_total") > large_page)
    bounds = _stretches(candidates, large, stretches)
    split = F.coalesce("_split", F.lit(False))
    bucketed = candidates.join(
        bounds, _matches(candidates, bounds, ["page_id", "confidence", "ord_hi"]), "left").withColumns({
            "_confidence": F.when(split, F.col("confidence")),
            "_hi": F.when(split, F.col("ord_hi")),
            "_stretch": F.when(split, F.size(F.filter(
                F.coalesce("_bounds", F.array().cast("array<bigint>")),
                lambda bound: bound < F.col("ord_lo")))),
        }).select(*candidates.columns, "_confidence", "_hi", "_stretch")
    bucket = ["page_id", "_confidence", "_hi", "_stretch"]
    inside = Window.partitionBy(*bucket)
    numbered = bucketed.withColumns({
        "_inside": F.row_number().over(inside.orderBy(*best_first())),
        "_own": F.count("*").over(inside)})
    sizes = bucketed.where(F.col("_stretch").isNotNull()).groupBy(*bucket).agg(
        F.count("*").alias("_size"))
    page = Window.partitionBy("page_id")
    ahead = page.orderBy(F.col("_confidence").desc(), "_hi", "_stretch").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(name).alias(f"at{name}") for name in bucket],
        F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_size").over(page).alias("_all"))
    ranked = numbered.join(offsets, _matches(numbered, offsets, bucket), "left")
    added = {rank: (F.coalesce("_ahead", F.lit(0)) + F.col("_inside")).cast("bigint")}
    if total is not None:
        added[total] = F.coalesce("_all", "_own").cast("bigint")
    return ranked.withColumns(added).select(*candidates.columns, *added)
