"""Text normalisation, noise predicates and coupon-code rules as Columns."""

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.regex import (
    SPACE, contains_any, grab, hit, jvm, literal_alternation, some, starts_with_any,
)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


#: Whitespace but the blank has none of these characters; two ranges are a quick test.
_COMMON = r"[^\x20-\x7e\u3001-\uffff]"


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one blank; untouched text skips the rewrite."""
    untidy = text.contains("  ") | (
        text.rlike(_COMMON) & text.rlike(SPACE.replace(r"\x20", r"\x1f")))
    return F.when(untidy, F.regexp_replace(text, SPACE + "+", " ")).otherwise(text)


def strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


_FOLDED = "\u017f\u0131\u0130\u212a"


def folds_plainly(text: Column) -> Column:
    """No letter whose folded form is another than its lower case."""
    return is_ascii(text) | ~contains_any(text, tuple(_FOLDED))


def fold(text: Column) -> Column:
    """Lower case in which letters equal under case folding share one spelling."""
    return F.when(folds_plainly(text), F.lower(text)).otherwise(
        F.lower(F.translate(text, _FOLDED, "siik")))


# --- HTML entities ----------------------------------------------------------------

_ENTITY_TOKENS = (
    r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
)


# Marks around the names of a letter; neither occurs in a name or a value.
_NAME, _VALUE = "\u0001", "\u0002"


@lru_cache(maxsize=1)
def _entity_json() -> str:
    """Names and values of the named entities, one marked list for each first letter."""
    lists: dict[str, str] = {}
    for name, value in html5.items():
        lists[name[0]] = lists.get(name[0], _NAME) + f"{name}{_VALUE}{value}{_NAME}"
    return json.dumps(lists)


def _named(name: Column, rest: Column) -> Column:
    """Value of a name and the rest, null if the name is not known.

    The table is a literal map from a letter to the names that begin with it, some hundred
    characters.  A map of maps would be the same to read, but no two plans with one compare
    equal, so their shuffles would not be shared.
    """
    table = F.from_json(F.lit(_entity_json()), "map<string,string>")

    marked = F.concat(F.lit(_NAME), name, F.lit(_VALUE))
    after = F.split_part(F.try_element_at(table, F.left(name, F.lit(1))), marked, F.lit(2))
    return bound(F.substring_index(after, _NAME, 1), lambda found: F.when(
        found != "", F.concat(found, rest)))


@lru_cache(maxsize=1)
def _open_entity_pattern() -> str:
    """Names that are valid without a semicolon, longest first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return f"^&({literal_alternation(tuple(names))})(.*)$"


@lru_cache(maxsize=1)
def _control_json() -> str:
    """Code points 0x80-0x9f are read as Windows-1252 where that code page has them."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[str(code)] = chr(code)
    return json.dumps(table, ensure_ascii=False)


def _code_point(number: Column) -> Column:
    """Character of a code point; a number too large to hold is null here."""
    as_text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    controls = F.from_json(F.lit(_control_json()), "map<string,string>")
    unprintable = (
        number.between(0x1, 0x8) | number.between(0xE, 0x1F) | (number == 0xB)
        | (number == 0x7F) | number.between(0xFDD0, 0xFDEF)
        | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF)
               | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(number.between(0x80, 0x9F), F.try_element_at(controls, number.cast("string")))
        .when(unprintable, F.lit(""))
        .otherwise(as_text)
    )


def _number(token: Column) -> Column:
    """Code point of a numeric reference, null where it is too large to hold."""
    hexits = F.ltrim(F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
    digits = F.regexp_extract(token, "^&#([0-9]+)", 1).try_cast("bigint")
    return F.when(token.rlike("^&#[xX]"), F.when(
        F.length(hexits) < 9,
        F.conv(F.concat(F.lit("0"), hexits), 16, 10).cast("bigint"))).otherwise(digits)


def _decode_token(token: Column) -> Column:
    """A reference by its whole name, or by the longest known name it starts with.

    Each step runs only for the tokens that the ones before it leave open.
    """
    whole = _named(F.substring(token, 2, 40), F.lit(""))
    start = bound(
        F.regexp_extract(token, "(?s)" + _open_entity_pattern(), 1),
        lambda name: F.when(name != "", _named(name, F.substr(token, F.length(name) + 2))))
    return (
        F.when(~token.startswith("&") | (F.length(token) == 1), token)
        .when(token.startswith("&#") & (F.length(token) > 2), bound(_number(token), _code_point))
        .otherwise(F.coalesce(whole, start, token))
    )


def decode_entities(text: Column) -> Column:
    """HTML character references to characters; text without ``&`` is passed through."""
    tokens = F.regexp_extract_all(text, F.lit("(?s)" + _ENTITY_TOKENS), F.lit(0))
    decoded = F.transform(tokens, _decode_token)
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


# --- normalisation ----------------------------------------------------------------

def normalize_plain(text: Column) -> Column:
    return strip(collapse(text), V.STRIP_PLAIN)


def visible(text: Column) -> Column:
    """No-break blanks become blanks, zero-width ones go."""
    plain = is_ascii(text) | ~contains_any(text, ("\u00a0", "\u200b"))
    return F.when(plain, text).otherwise(F.translate(text, "\u00a0\u200b", " "))


def staged(df: DataFrame, name: str, *steps: Callable[[Column], Column],
           value: Column | None = None) -> DataFrame:
    """Set one column step by step in a single select.

    Steps mention their input several times.  As lateral aliases each becomes one
    projection, so the plan stays linear in the steps and is analysed once.
    """
    aliases, last = [], F.col(name) if value is None else value
    for number, step in enumerate(steps):
        alias = f"_{name}_step{number}"
        aliases.append(step(last).alias(alias))
        last = F.col(alias)
    kept = [column for column in df.columns if column != name]
    return df.select("*", *aliases).select(*kept, last.alias(name))


def keep_rows(df: DataFrame, condition: Column, keys: tuple[str, ...],
              columns: tuple[str, ...]) -> DataFrame:
    """Filter on computed columns without computing them twice.

    A plain filter is pushed through the projections below it, which copies every
    expression behind the condition; an array of zero or one struct is not.
    """
    row = F.when(F.col("_keep"), F.array(F.struct(*columns)))
    return df.select("*", condition.alias("_keep")).select(
        *keys, F.explode(row).alias("_row")).select(*keys, "_row.*")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later lambdas may read per element without recomputing them.

    A projection could be merged into the expression above it and so run once for every
    element there; the output of an explode cannot.
    """
    row = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.explode(row).alias("_once")).select(*kept, "_once.*")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once and may be used many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_generic(df: DataFrame, name: str) -> DataFrame:
    return staged(
        df, name, decode_entities, visible, collapse, lambda c: strip(c, V.STRIP_GENERIC))


def _remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, "(?iu)" + jvm(pattern), "")


def _phrases(words: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _without_call_to_action(text: Column) -> Column:
    bare = _remove(text, _phrases(V.CTA_GENERIC))
    bare = _remove(bare, r"\bverified\b")
    bare = _remove(bare, V.INTERESTED_USERS)
    return strip(F.regexp_replace(bare, " +", " "), V.STRIP_CLEANED)


def _is_call_to_action(folded: Column) -> Column:
    """Cheap superset test for the phrases that cleaning removes."""
    return contains_any(folded, V.CTA_GENERIC + ("verified", "interested user"))


@lru_cache(maxsize=None)
def _cleaning_columns(name: str, only: str | None, only_if_left: bool) -> tuple[Column, ...]:
    """Steps of ``clean_lines`` as lateral aliases, the cleaned text last."""
    c, text = F.col, F.col(name)
    steps, condition = {}, None if only is None else c(only)
    if only_if_left:
        steps["_left_fold"] = fold(text)
        steps["_left"] = text.contains("&") | _is_call_to_action(c("_left_fold"))
        condition = c("_left")
    steps["_decoded"] = decode_entities(
        text if condition is None else F.when(condition, text))
    steps["_visible"] = visible(c("_decoded"))
    steps["_normal"] = strip(collapse(c("_visible")), V.STRIP_GENERIC)
    steps["_fold"] = fold(c("_normal"))
    steps["_cta"] = _is_call_to_action(c("_fold"))
    cleaned = F.when(c("_cta"), _without_call_to_action(c("_normal"))).otherwise(c("_normal"))
    if condition is not None:
        cleaned = F.when(condition, cleaned).otherwise(text)
    steps["_cleaned"] = cleaned
    return tuple(step.alias(alias) for alias, step in steps.items())


def clean_lines(df: DataFrame, name: str, only: str | None = None,
                only_if_left: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Normalise a column of lines and take call-to-action noise out of it.

    ``only`` names a boolean column that limits the work to some rows; ``only_if_left``
    limits it to those that still hold an entity or a phrase.  Other rows keep their text.
    ``also`` names steps that stay as columns.
    """
    kept = [column for column in df.columns if column != name]
    return df.select("*", *_cleaning_columns(name, only, only_if_left)).select(
        *kept, F.col("_cleaned").alias(name), *also)


def clean_site_offer(text: Column) -> Column:
    bare = normalize_plain(text)
    bare = _remove(bare, _phrases(V.CTA_SITE))
    bare = _remove(bare, V.INTERESTED_USERS)
    bare = _remove(bare, V.ADDED_BY)
    bare = _remove(bare, r"\bverified\b")
    bare = _remove(bare, r"\bexclusive\b")
    return strip(F.regexp_replace(bare, SPACE + "+", " "), V.STRIP_CLEANED)


def normalize_candidate_text(text: Column) -> Column:
    return F.btrim(collapse(text))


SEPARATORS = r"[|•·]"


def is_packed(text: Column) -> Column:
    return contains_any(text, tuple(SEPARATORS[1:-1]))


def split_packed(text: Column) -> Column:
    """Pieces of a packed line; the line itself when there are not two of them."""
    pieces = F.filter(
        F.split(text, f"{SPACE}*{SEPARATORS}{SPACE}*"), lambda piece: piece != "")
    whole = F.array(text)
    return F.when(is_packed(text) & (F.size(pieces) > 1), pieces).when(text != "", whole)


# --- predicates -------------------------------------------------------------------

def fits_line_length(text: Column) -> Column:
    return F.length(text).between(V.MIN_LINE_CHARS, V.MAX_LINE_CHARS)


def is_noise_line(text: Column, low: Column | None = None, folded: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    folded = fold(text) if folded is None else folded
    return (
        (F.length(low) < V.MIN_LINE_CHARS)
        | starts_with_any(low, V.QUESTION_PREFIXES)
        | (low.contains("@") & ~hit(folded, V.EN_CODE))
        | low.isin(*V.DEAL_HEADINGS, *V.NAVIGATION_WORDS)
        | contains_any(low, V.NOISE_PHRASES)
    )


def is_noise_site_offer(text: Column) -> Column:
    low = F.lower(text)
    return (
        (F.length(low) < V.MIN_SITE_OFFER_CHARS)
        | starts_with_any(low, V.SITE_QUESTION_PREFIXES)
        | contains_any(low, V.SITE_NOISE_PHRASES)
    )


# --- coupon codes and numbers -----------------------------------------------------

def normalize_code(text: Column) -> Column:
    return F.upper(strip(text, V.STRIP_CODE))


def is_coupon_code(code: Column) -> Column:
    """``code`` is already normalised."""
    return (
        F.length(code).between(3, 20)
        & code.rlike("^[A-Z0-9-]+$")
        & ~code.rlike("^[0-9]+$")
        & ~code.isin(*V.CODE_STOPWORDS)
        & ~code.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        & ~(code.rlike("^[A-Z]+$") & (F.length(code) < 5))
    )


def valid_code(capture: Column) -> Column:
    code = normalize_code(capture)
    return F.when(is_coupon_code(code), code)


@lru_cache(maxsize=1)
def _digit_table() -> tuple[str, str]:
    """Every decimal digit outside ASCII and the ASCII digit it stands for."""
    digits = [
        (char, str(unicodedata.decimal(char)))
        for char in map(chr, range(0x80, sys.maxunicode + 1))
        if unicodedata.category(char) == "Nd"
    ]
    return "".join(char for char, _ in digits), "".join(digit for _, digit in digits)


def to_number(capture: Column) -> Column:
    """Null for the empty text of a capture without a match.

    A cast of that would raise and catch an error, which costs more than the match itself.
    """
    foreign, ascii_digits = _digit_table()
    plain = F.when(is_ascii(capture), capture).otherwise(
        F.translate(capture, foreign, ascii_digits))
    return F.when(capture != "", plain.try_cast("double"))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(
            F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, 2, 2147483647)))),
        "")


# --- store names from page headings -----------------------------------------------

def store_from_heading(value: Column) -> Column:
    """Store named by one normalised heading, null when it names none."""
    stripped = [
        some(F.btrim(grab(value, suffix, flags="(?iu)"))) for suffix in V.STORE_SUFFIXES]
    whole = F.when(
        (value != "") & ~F.lower(value).isin(*V.DEAL_HEADINGS),
        F.substring(value, 1, V.STORE_CHARS))
    return F.coalesce(*stripped, whole)


def with_store_from_page(df: DataFrame, store: str, h1: str, title: str,
                         site_name: str) -> DataFrame:
    """Store from the first heading that names one, null when none does."""
    names = F.transform(F.array(h1, title, site_name), lambda heading: bound(
        decode_entities(heading), lambda decoded: bound(
            visible(decoded), lambda seen: strip(collapse(seen), V.STRIP_GENERIC))))
    found = F.transform(names, store_from_heading)
    return df.withColumn(
        store, F.get(F.filter(found, lambda name: name.isNotNull()), F.lit(0)))


def store_from_site_heading(h1: Column) -> Column:
    return some(F.btrim(grab(normalize_plain(h1), V.SITE_STORE_HEADING, flags="(?iu)")))


def page_title(html: Column) -> Column:
    return decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
