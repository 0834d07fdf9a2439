"""Output lines, records and report documents as Columns and row fragments.

A report is a sequence of fragments (page_id, seq, text) rather than one cell, so a page
with very many offers is still written by many tasks.  Joined by line breaks in ``seq``
order, the fragments are the document.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions import values as V
from offerlode.functions.regex import some
from offerlode.operators.dedup import with_rank


def output_line() -> Column:
    """``STORE | OFFER | CODE | conditions``; ``concat_ws`` leaves absent conditions out."""
    c = F.col

    def named(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}="), value))

    def percent(name: str) -> Column:
        return F.concat(S.format_short(c(name)), F.lit("%"))

    conditions = F.concat_ws(
        ", ",
        named("type", F.lower("offer_type")),
        named("cashback", percent("cashback_percent")),
        named("max_discount", c("max_discount_amount")),
        named("discount_amount", c("discount_amount")),
        named("discount", percent("discount_percent")),
        named("discount_type", c("discount_type")),
        named("expiry", c("expiry")),
        named("expiry_type", c("expiry_type")),
        named("min_spend", c("min_spend")),
        named("confidence", S.two_digits(c("confidence"))),
    )
    return F.concat_ws(
        " | ",
        F.coalesce(some(c("store")), F.lit(V.UNKNOWN_STORE)),
        S.best_offer_text(c("offer"), c("normalized_line")),
        F.coalesce(some(c("coupon_code")), some(c("offer_type")), F.lit("NO_CODE")),
        conditions)


def records(candidates: DataFrame, *keys: str) -> DataFrame:
    """The 15 output fields, confidence rounded to three digits."""
    return candidates.select(*keys, *[
        F.round("confidence", 3).alias(name) if name == "confidence" else F.col(name)
        for name in V.RECORD_FIELDS])


def csv_fields(candidates: DataFrame, *keys: str) -> DataFrame:
    """The 13 CSV columns as text, blanks for nulls."""
    return records(candidates, *keys).select(*keys, *[
        F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in V.CSV_FIELDS])


def csv_report(summaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fragments of the CSV report: a header for every page, then its ranked rows."""
    options = {"escape": '"', "emptyValue": "", "nullValue": ""}
    head = summaries.select(
        "page_id", F.lit(0).cast("bigint").alias("seq"), F.lit(",".join(V.CSV_FIELDS)).alias("text"))
    row = F.to_csv(F.struct(*[
        F.round("confidence", 3).alias(name) if name == "confidence" else F.col(name)
        for name in V.CSV_FIELDS]), options)
    return head.unionByName(with_rank(candidates).select(
        "page_id", F.col("rank").alias("seq"), row.alias("text")))


FALLBACK_COLUMNS = ("used_llm_fallback", "fallback_response_text", "fallback_error")


def _with_fallback_columns(summaries: DataFrame) -> DataFrame:
    defaults = (F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return summaries.withColumns({
        name: default for name, default in zip(FALLBACK_COLUMNS, defaults)
        if name not in summaries.columns})


def _fragments(summaries: DataFrame, texts: Column) -> DataFrame:
    return summaries.select("page_id", F.explode(texts).alias("f")).select(
        "page_id", "f.seq", "f.text")


def _piece(seq: Column, text: Column) -> Column:
    return F.struct(seq.cast("bigint").alias("seq"), text.alias("text"))


def text_report(summaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fragments of the plain-text report."""
    c, count = F.col, F.col("candidate_count")
    pages = _with_fallback_columns(summaries)
    response, error = some(c("fallback_response_text")), some(c("fallback_error"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("OVERALL_CONFIDENCE="), S.two_digits(c("overall_confidence"))),
        F.concat(F.lit("USED_LLM_FALLBACK="),
                 F.when(c("used_llm_fallback"), "yes").otherwise("no")),
        F.lit("HEURISTIC_CANDIDATES"), F.when(count == 0, F.lit(V.NO_DEALS)))
    tail = F.concat_ws(
        "\n", F.when(response.isNotNull(), F.concat(F.lit("LLM_FALLBACK_OUTPUT\n"), response)),
        F.when(error.isNotNull(), F.concat(F.lit("LLM_FALLBACK_ERROR\n"), error)))
    outer = _fragments(pages, F.filter(
        F.array(_piece(F.lit(0), head), _piece(count + 1, tail)),
        lambda piece: piece["text"] != ""))
    ranked = with_rank(candidates)
    return outer.unionByName(ranked.select(
        "page_id", c("rank").alias("seq"), output_line().alias("text")))


#: What JSON escapes, and what stands for broken bytes; other texts are quoted as they are.
_ESCAPED = r'["\\\x00-\x1f\x7f\ufffd]'


def json_text(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).when(
        ~value.rlike(_ESCAPED), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(
        F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def json_texts(values: Column, separator: str) -> Column:
    """Quoted items of an array, joined; one by one only where an item needs it."""
    plain = ~F.array_join(values, "", "\x00").rlike(_ESCAPED)
    return F.when(plain & (F.size(values) > 0), F.concat(
        F.lit('"'), F.array_join(values, f'"{separator}"'), F.lit('"'))).otherwise(
        F.array_join(F.transform(values, json_text), separator))


def json_number(value: Column) -> Column:
    """A double as JSON libraries print it: an exponent only from 1e16 on, with its sign."""
    text = value.cast("string")
    plain = F.concat(F.regexp_replace(
        value.cast("decimal(38,10)").cast("string"), r"\.?0+$", ""), F.lit(".0"))
    whole = F.abs(value).between(1e7, 9.999999999999998e15)
    exact = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"0+$", "")
    signed = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E([0-9])", "e+$1")
    return F.when(whole & exact.endswith("."), plain).when(whole, exact).otherwise(signed)


def json_report(summaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fragments of the indented JSON report; null candidate fields stay in."""
    c, count = F.col, F.col("candidate_count")
    pages = _with_fallback_columns(summaries)
    response, error = some(c("fallback_response_text")), some(c("fallback_error"))
    head = F.concat_ws(
        "\n", F.lit("{"),
        F.concat(F.lit('  "overall_confidence": '), c("overall_confidence").cast("string"),
                 F.lit(",")),
        F.concat(F.lit('  "used_llm_fallback": '), c("used_llm_fallback").cast("string"),
                 F.lit(",")),
        F.concat(F.lit('  "candidate_count": '), count.cast("string"), F.lit(",")),
        F.when(count > 0, F.lit('  "candidates": [')))
    tail = F.concat(
        F.when(count > 0, F.lit("  ]")).otherwise(F.lit('  "candidates": []')),
        F.when(response.isNotNull(), F.concat(
            F.lit(',\n  "llm_fallback_output": '), json_text(response))).otherwise(""),
        F.when(error.isNotNull(), F.concat(
            F.lit(',\n  "llm_fallback_error": '), json_text(error))).otherwise(""),
        F.lit("\n}"))
    outer = _fragments(pages, F.array(_piece(F.lit(0), head), _piece(count + 1, tail)))

    def entry(name: str) -> Column:
        if name == "reasons":
            items = json_texts(c(name), ",\n        ")
            value = F.when(F.size(name) == 0, F.lit("[]")).otherwise(
                F.concat(F.lit("[\n        "), items, F.lit("\n      ]")))
        elif name == "confidence":
            value = F.round(c(name), 3).cast("string")
        elif name in ("discount_percent", "cashback_percent"):
            value = F.coalesce(json_number(c(name)), F.lit("null"))
        else:
            value = json_text(c(name))
        return F.concat(F.lit(f'      "{name}": '), value)

    ranked = with_rank(candidates, total="page_total")
    body = F.concat(
        F.lit("    {\n"), F.concat_ws(",\n", *map(entry, V.RECORD_FIELDS)),
        F.when(c("rank") < c("page_total"), F.lit("\n    },")).otherwise(F.lit("\n    }")))
    return outer.unionByName(ranked.select(
        "page_id", c("rank").alias("seq"), body.alias("text")))


def parse_output_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Rows from ``STORE | OFFER | CODE | CONDITIONS`` lines; other lines are dropped."""
    line = F.btrim(F.col(text))
    parts = F.split(line, r"\s*\|\s*", 4)
    kept = [name for name in lines.columns if name != text]
    split = lines.select(*kept, line.alias("line"), parts.alias("parts"))
    return split.where((F.size("parts") == 4) & (F.col("line") != V.NO_DEALS)).select(
        *kept, *[F.get("parts", F.lit(i)).alias(name) for i, name in enumerate(
            ("store", "offer", "code", "conditions"))])
