"""HTML cleaning, text and container selection over tokenised pages.

A page is one row: what survives cleaning is in arrays of it, so every rule here is
row-local and nothing is shuffled until candidates exist.
"""

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from offerlode.functions import tokenizer
from offerlode.functions import values as V
from offerlode.functions.regex import SPACE
from offerlode.functions.text import bound, with_store_from_page
from offerlode.functions.tokenizer import (
    CLOSE, LINK, OPEN, TEXT, TOKEN_FIELDS, tokenize_batches,
)
from offerlode.functions.urls import store_from_url

# The tokeniser travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(tokenizer)


def tokenize(pages: DataFrame, html: str = "html") -> DataFrame:
    """Columns of ``pages`` plus the kept parts of each page, its flags and ``error``."""
    kept = [field for field in pages.schema.fields if field.name != "error"]
    schema = T.StructType(kept + TOKEN_FIELDS)
    arrow = to_arrow_schema(schema)
    return pages.select(*[field.name for field in kept]).mapInArrow(
        tokenize_batches(html, arrow), schema)


def events_of(*kinds: int) -> Column:
    return F.filter("events", lambda event: event["kind"].isin(*kinds))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def text_nodes(tokens: DataFrame, *columns: str) -> DataFrame:
    """One row per non-blank text node of the cleaned page."""
    exploded = tokens.select(
        *columns, F.posexplode(events_of(TEXT)).alias("node_idx", "node"))
    return exploded.select(
        *columns, "node_idx", F.col("node.element").alias("element"),
        F.col("node.line").alias("block"), _strip(F.col("node.text")).alias("text")
    ).where(F.col("text") != "")


def cleaned_text() -> Column:
    """Markdown-like text: one line per block, links as ``[text](target)``."""
    parts = F.filter(events_of(TEXT, LINK), lambda event: event["text"] != "")
    joined = bound(parts, lambda all_parts: F.transform(
        all_parts, lambda part, i: F.concat(
            F.when((i > 0) & (part["line"] != F.get(all_parts, i - 1)["line"]), "\n")
            .otherwise(""),
            F.regexp_replace(part["text"], SPACE + "+", " "))))
    text = F.array_join(joined, "")
    return _strip(F.regexp_replace(F.regexp_replace(text, " *\n[ \n]*", "\n"), " +", " "))


def cleaned_html() -> Column:
    """Body of the cleaned page without empty wrappers; blank or rootless pages give ''."""
    kept = F.filter(events_of(OPEN, TEXT, CLOSE), lambda event: ~event["blank"] & ~F.coalesce(
        F.col("has_body") & (F.get(F.col("elements"), event["element"])["tag"] == "html"),
        F.lit(False)))
    body = F.array_join(F.transform(kept, lambda event: event["text"]), "")
    return F.when(F.col("root_dropped"), F.lit("")).otherwise(_strip(body))


def first_text(tag: str) -> Column:
    """Text of the first element of ``tag``, pieces joined by blanks."""
    found = F.get(F.filter("elements", lambda e: e["tag"] == tag), F.lit(0))
    return joined_text(found["first"], found["last"])


def joined_text(first: Column, last: Column) -> Column:
    """Non-blank text between two events, pieces joined by blanks."""
    inside = F.filter(F.slice(F.col("events"), first + 1, last - first),
                      lambda event: event["kind"] == TEXT)
    pieces = F.filter(F.transform(inside, lambda event: _strip(event["text"])),
                      lambda text: text != "")
    return F.array_join(pieces, " ")


def site_name() -> Column:
    found = F.filter("elements", lambda e: (e["tag"] == "meta")
                     & (e["property"] == "og:site_name") & (e["content"] != ""))
    return F.when(~F.col("has_body"), F.get(found, F.lit(0))["content"])


def with_page_store(tokens: DataFrame, url: str = "url", store: str = "store") -> DataFrame:
    """Adds the page's store: headings of what is left after cleaning, else the URL."""
    named = with_store_from_page(
        tokens.withColumns({"_h1": first_text("h1"), "_title": first_text("title"),
                            "_site": site_name()}),
        store, "_h1", "_title", "_site").drop("_h1", "_title", "_site")
    return named.withColumn(store, F.coalesce(store, store_from_url(F.col(url))))


# --- containers -------------------------------------------------------------------

def container_line_array(html: str | None = None) -> Column:
    """The whole text of each container, then each string in its best container.

    Elements are (ord_hi, line_no, line, raw_html), ord_hi being the container's selector
    and place.  Every string is listed once: of nested containers the one with the first
    selector, then the outermost, has it.
    """
    def snippet(c: Column) -> Column:
        return F.lit("") if html is None else F.substring(
            F.col(html), c["start"] + 1,
            F.least(c["stop"] - c["start"], F.lit(V.SNIPPET_CHARS)))

    def row(c: Column, line_no: Column, line: Column) -> Column:
        return F.struct(c["rank"].alias("ord_hi"), line_no.alias("line_no"),
                        line.alias("line"), c["raw_html"].alias("raw_html"))

    cut = F.transform("containers", lambda c: F.struct(
        c["rank"].alias("rank"), c["first"].alias("first"), c["last"].alias("last"),
        snippet(c).alias("raw_html")))
    inside = F.filter("strings", lambda s: s["container"] >= 0)

    def whole(c: Column) -> Column:
        texts = F.slice(F.col("strings"), c["first"] + 1, c["last"] - c["first"])
        return row(c, F.lit(0), F.array_join(F.transform(texts, lambda s: s["text"]), " "))

    return bound(cut, lambda found: F.concat(
        F.transform(found, whole),
        F.transform(inside, lambda s: row(
            F.get(found, s["container"]), s["line_no"], s["text"]))))


def container_lines(tokens: DataFrame, *columns: str, html: str | None = None) -> DataFrame:
    return tokens.select(*columns, F.explode(container_line_array(html)).alias("l")).select(
        *columns, "l.*")
