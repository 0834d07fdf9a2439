"""Domain routing: which extractor a page goes to, and running them all on one scan."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.text import keep_rows
from offerlode.functions.urls import domain
from offerlode.operators import lines as L
from offerlode.operators.dedup import keep_first

Extractor = Callable[[DataFrame], DataFrame]

NOTES = "struct<x_data:string,title:string,badges:array<string>,metadata:array<string>,all_text:string>"
PAGE = "struct<title:string,cleaned_html:string,cleaned_text:string,error:string>"


def line_struct(ord_hi: Column, line_no: Column, line: Column, raw_html: Column,
                notes: Column | None = None, page: Column | None = None) -> Column:
    """One row that a page gives: a text line, a row of notes, or the page's own record."""
    nothing = F.lit(None)
    return F.struct(
        ord_hi.cast("bigint").alias("ord_hi"), line_no.cast("int").alias("line_no"),
        line.alias("line"), raw_html.alias("raw_html"),
        (nothing if notes is None else notes).cast(NOTES).alias("notes"),
        (nothing if page is None else page).cast(PAGE).alias("page"))


def mark(number: Column) -> Column:
    """Text of a row that is no line: no page text passes for it, as it holds no signal."""
    return F.concat(F.lit("\u0002"), number.cast("string"))


@dataclass(frozen=True)
class LineExtractor:
    """An extractor that shares the scan with others.

    ``lines`` turns tokenised pages into a store column and an array of ``line_struct``;
    text lines among them are cleaned, split and gated, rows with notes stay as they are.
    ``finish`` makes candidates of what is left, one row per page and text.
    """

    lines: Callable[[DataFrame], tuple[DataFrame, Column, Column]]
    finish: Callable[[DataFrame], DataFrame]

    def __call__(self, tokens: DataFrame) -> DataFrame:
        prepared, store, rows = self.lines(tokens)
        return self.finish(distinct_lines(prepared.select(
            "page_id", store.alias("store"), F.explode(rows).alias("l")).select(
            "page_id", "store", "l.*")))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """Gated lines, each text of a page at its first place; rows that are no lines all stay."""
    parts = L.explode_parts(rows)
    no_line = F.col("notes").isNotNull() | F.col("page").isNotNull()
    gated = L.offer_lines(parts, always=no_line).withColumn(
        "ord_lo", L.text_position("line_no")).drop("line_no", "part_no", "fold")
    return keep_first(gated, ["page_id", "offer"], [F.col("ord_hi"), F.col("ord_lo")])


@dataclass
class Routes:
    """Extractors by name and the domains that lead to them; the last entry wins.

    A ``LineExtractor`` shares the scan; any other turns tokenised pages into candidate
    rows and gets a scan of its own pages.
    """

    extractors: dict[str, Extractor] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, domains: tuple[str, ...], extractor: Extractor) -> "Routes":
        self.extractors[name] = extractor
        self.domains.update({host.lower(): name for host in domains})
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(self.domains.items())
        return spark.createDataFrame(rows, "domain string, extractor string")

    def sharing(self) -> dict[str, LineExtractor]:
        return {name: one for name, one in self.extractors.items() if isinstance(one, LineExtractor)}


def route(pages: DataFrame, routes: Routes, url: str = "url") -> DataFrame:
    """Pages with ``extractor``.

    The domain table holds what the program registered, so it is small by construction
    and broadcast; unknown domains go to the generic extractor.
    """
    table = F.broadcast(routes.table(pages.sparkSession))
    return pages.withColumn("domain", domain(F.col(url))).join(
        table, "domain", "left"
    ).withColumn("extractor", F.coalesce("extractor", F.lit(V.GENERIC)))


def page_rows(tokens: DataFrame, routes: Routes, page: Column | None = None,
              lines_if: Column | None = None) -> DataFrame:
    """(page_id, extractor, store and what ``distinct_lines`` keeps) of routed, tokenised pages.

    A page is scanned and tokenised once, whichever extractor reads it.  With ``page``, each
    page also gives a row that holds this record; ``lines_if`` limits the pages that give more.
    """
    c, named = F.col, tokens
    stores, arrays = F.lit(None).cast("string"), F.lit(None)
    for number, (name, extractor) in enumerate(routes.sharing().items()):
        named, store, rows = extractor.lines(named)
        named = named.withColumn(f"_store{number}", store)
        stores = F.when(c("extractor") == name, c(f"_store{number}")).otherwise(stores)
        arrays = F.when(c("extractor") == name, rows).otherwise(arrays)
    if page is not None:
        own = F.array(line_struct(F.lit(0), F.lit(0), mark(F.lit("page")), F.lit(""), page=page))
        if lines_if is not None:
            arrays = F.when(lines_if, arrays)
        arrays = F.concat(own, F.coalesce(arrays, F.slice(own, 1, 0)))
    lines = named.select("page_id", "extractor", stores.alias("store"), F.explode(arrays).alias("l"))
    return distinct_lines(lines.select("page_id", "extractor", "store", "l.*"))


def rows_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Some of the rows, chosen behind their shuffle.

    A plain filter, and the columns a branch leaves out, would be pushed below the shuffle
    and each branch would scan the pages anew; so all branches read the same one.
    """
    return keep_rows(rows, condition, (), tuple(rows.columns))


def extract_all(routed: DataFrame, routes: Routes, prepare: Extractor) -> DataFrame:
    """Candidates of every page by its extractor, as one union.

    ``prepare`` tokenises; extractors that share the scan read the same tokens.
    """
    sharing = routes.sharing()
    rows = page_rows(prepare(routed.where(F.col("extractor").isin(*sharing))), routes)
    return candidates_of(rows, routes, routed, prepare)


def candidates_of(rows: DataFrame, routes: Routes, routed: DataFrame,
                  prepare: Extractor) -> DataFrame:
    """Candidates from ``page_rows``, and from the extractors that read pages themselves."""
    parts = [
        extractor.finish(rows_where(
            rows, (F.col("extractor") == name) & F.col("page").isNull()).drop("extractor"))
        for name, extractor in routes.sharing().items()
    ] + [
        extractor(prepare(routed.where(F.col("extractor") == name)))
        for name, extractor in routes.extractors.items() if not isinstance(extractor, LineExtractor)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
