"""URL projections and predicates as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.text import strip_space, title_case

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def _after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, _SCHEME, ""), "^([^#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^//([^/?]*)", 1)


def path(url: Column) -> Column:
    hierarchy = F.regexp_extract(_after_scheme(url), "^([^?]*)", 1)
    return F.regexp_replace(F.regexp_replace(hierarchy, "^//[^/]*", ""), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^?]*\?(.*)$", 1)


def looks_like_url(text: Column) -> Column:
    url = with_scheme(strip_space(text))
    return (
        (strip_space(text) != "")
        & scheme(url).isin("http", "https")
        & (authority(url) != "")
    )


def normalized_url(text: Column) -> Column:
    url = strip_space(text)
    return F.when(scheme(url) == "", F.concat(F.lit("https://"), url)).otherwise(url)


def url_error(text: Column) -> Column:
    """Why a requested URL cannot be used, null when it can."""
    url = normalized_url(text)
    return (
        F.when(F.coalesce(strip_space(text), F.lit("")) == "", F.lit(V.URL_EMPTY))
        .when(~scheme(url).isin("http", "https"), F.lit(V.URL_BAD_SCHEME))
        .when(authority(url) == "", F.lit(V.URL_NO_DOMAIN))
    )


def domain(url: Column) -> Column:
    return F.lower(authority(with_scheme(url)))


def output_stem(row_number: Column, url: Column) -> Column:
    candidate = strip_space(url)
    full = with_scheme(candidate)
    query_part = F.when(query(full) != "", F.concat(F.lit("_"), query(full))).otherwise("")
    source = F.concat(authority(full), path(full), query_part)
    source = F.when(F.btrim(source, F.lit("_/")) == "", candidate).otherwise(source)
    slug = F.btrim(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "_"), F.lit("_"))
    slug = F.when(slug == "", F.lit("url")).otherwise(slug)
    return F.concat(
        F.format_string("row_%05d_", row_number), F.substring(slug, 1, V.STEM_CHARS))


def store_from_url(url: Column) -> Column:
    full = with_scheme(url)
    trimmed = F.btrim(path(full), F.lit("/"))
    slugs = [
        F.nullif(F.regexp_extract(trimmed, prefix + "([^/.]*)", 1), F.lit(""))
        for prefix in V.STORE_PATH_PREFIXES
    ]
    named = title_case(F.translate(F.coalesce(*slugs), "-_", "  "))
    host = F.replace(domain(url), F.lit("www."), F.lit(""))
    first_label = title_case(F.substring_index(host, ".", 1))
    return F.coalesce(
        named, F.when(host != "", first_label), F.lit(V.UNKNOWN_STORE))


def normalize_header(text: Column) -> Column:
    return F.btrim(
        F.regexp_replace(F.lower(strip_space(text)), "[^a-z0-9]+", "_"), F.lit("_"))
