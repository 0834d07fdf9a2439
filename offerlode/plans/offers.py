"""End-to-end plans: lines or pages in, candidates and reports out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.operators import lines as L
from offerlode.operators.dedup import (
    LARGE_PAGE, deduplicate, rank_and_filter, ranked_pages, split_by_size,
)
from offerlode.operators.signals import parse_offers, with_folded
from offerlode.sources.tables import offer_lines

FIXTURE_PART_BITS = 10


def candidates_from_lines(lines: DataFrame, position: Column, store: Column,
                          raw_html: bool = False) -> DataFrame:
    """Text pass over (page_id, line, ...): one candidate per page and exact offer text.

    ``store`` may only use ``page_id``; it is added after the repeats are gone.
    """
    return _parsed(_first_lines(lines, position), store)


def _first_lines(lines: DataFrame, position: Column) -> DataFrame:
    gated = L.offer_lines(L.explode_parts(lines))
    return L.first_positions(gated, position, ("page_id",))


def _parsed(firsts: DataFrame, store: Column) -> DataFrame:
    ready = with_folded(firsts.withColumn("store", store)).drop("low")
    found = parse_offers(ready, ("page_id", "ord_lo"))
    return found.withColumns({
        "ord_hi": F.lit(L.PASS_TEXT), "raw_html": F.lit("")})


def ranked_from_lines(lines: DataFrame, position: Column, store: Column,
                      large_page: int = LARGE_PAGE) -> tuple[DataFrame, DataFrame]:
    """Offers of text lines, deduplicated and filtered, and the same with their ranks.

    A page has at most as many candidates as distinct lines, which are counted where they were
    grouped.  Lines of large pages are parsed apart; nothing is kept for the ranks.
    """
    small, large = split_by_size(_first_lines(lines, position), "ord_lo", large_page)
    return ranked_pages(_parsed(small, store), _parsed(large, store))


def _fixture(spark: SparkSession, folder: str) -> tuple[DataFrame, Column, Column]:
    return (
        offer_lines(spark, folder),
        L.text_position("line_id", part_bits=FIXTURE_PART_BITS),
        F.concat(F.lit("Shop "), F.col("page_id").cast("string")))


def fixture_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the derived offer lines, before deduplication across spellings."""
    return candidates_from_lines(*_fixture(spark, folder))


def fixture_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Deduplicated offers of the derived lines that pass the confidence filter."""
    return rank_and_filter(deduplicate(fixture_candidates(spark, folder)))


def ranked_fixture_offers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same offers, and with ``rank`` and ``page_total``."""
    return ranked_from_lines(*_fixture(spark, folder))
