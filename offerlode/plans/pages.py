"""Page plans: HTML in, candidates out, for every registered extractor."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.regex import LINE_BREAK
from offerlode.functions.urls import store_from_url
from offerlode.operators import dom
from offerlode.operators import lines as L
from offerlode.operators.dedup import distinct_offers, keep_first
from offerlode.operators.routing import LineExtractor, Routes, line_struct
from offerlode.operators.signals import parse_offers, with_folded
from offerlode.operators.site_rules import site_candidates

def generic_lines(tokens: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Container lines, then the lines of the cleaned text; store from the page's headings.

    Both passes come out of one row of the page, so it is read and tokenised once.
    """
    named = dom.with_page_store(tokens, store="_page_store")
    found = F.transform(dom.container_line_array("html"), lambda c: line_struct(
        c["ord_hi"], c["line_no"], c["line"], c["raw_html"]))
    text = F.transform(
        F.split(dom.cleaned_text(), LINE_BREAK), lambda line, n: line_struct(
            F.lit(L.PASS_TEXT), n, line, F.lit("")))
    return named, F.col("_page_store"), F.concat(found, text)


def candidates_of_rows(firsts: DataFrame) -> DataFrame:
    """Candidates of distinct gated lines (page_id, store, ord_hi, ord_lo, offer, raw_html)."""
    ready = with_folded(firsts).drop("low")
    return distinct_offers(parse_offers(ready, ("page_id", "ord_hi", "ord_lo", "raw_html")))


def candidates_of_lines(lines: DataFrame) -> DataFrame:
    """Candidates of (page_id, store, ord_hi, line_no, line, raw_html)."""
    gated = L.offer_lines(L.explode_parts(lines)).withColumn(
        "ord_lo", L.text_position("line_no")).drop("line_no", "part_no", "fold")
    return candidates_of_rows(keep_first(
        gated, ["page_id", "offer"], [F.col("ord_hi"), F.col("ord_lo")]))


#: Two-pass extraction of tokenised pages (page_id, url, html and their tokens).
generic_candidates = LineExtractor(generic_lines, candidates_of_rows)


def text_candidates(pages: DataFrame) -> DataFrame:
    """Text-only pages (page_id, url, text): the text pass, store from the URL."""
    named = pages.select("page_id", store_from_url(F.col("url")).alias("store"), "text")
    lines = L.explode_text(named).withColumns({
        "ord_hi": F.lit(L.PASS_TEXT), "raw_html": F.lit("")})
    return candidates_of_lines(lines)


def cleaned_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tokenised pages; blank pages never reach Python."""
    return dom.tokenize(pages.where(F.btrim(html) != ""), html)


def default_routes() -> Routes:
    return (
        Routes()
        .register(V.GENERIC, (), generic_candidates)
        .register(V.SITE, V.SITE_DOMAINS, site_candidates)
    )
