"""Rules for the coupon site whose offers sit in ``offer_strip`` links."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.regex import grab, hit, some
from offerlode.functions.text import (
    clean_site_offer, fold, is_noise_site_offer, keep_rows, normalize_plain,
    store_from_site_heading, to_number,
)
from offerlode.functions.tokenizer import OPEN
from offerlode.operators.dedup import deduplicate
from offerlode.operators.dom import first_text, joined_text
from offerlode.operators.routing import LineExtractor, line_struct, mark
from offerlode.operators.signals import CANDIDATE_FIELDS, with_score


def _inside(first: Column, last: Column, tag: str) -> Column:
    """Elements of ``tag`` below an element, in document order."""
    opened = F.filter(
        F.slice(F.col("events"), first + 2, last - first - 1),
        lambda event: event["kind"] == OPEN)
    elements = F.transform(opened, lambda event: F.get(F.col("elements"), event["element"]))
    return F.filter(elements, lambda element: element["tag"] == tag)


def _texts(elements: Column) -> Column:
    joined = F.transform(elements, lambda e: joined_text(e["first"], e["last"]))
    return F.filter(F.transform(joined, normalize_plain), lambda text: text != "")


def strip_lines(tokens: DataFrame) -> tuple[DataFrame, Column, Column]:
    """One row with notes per offer strip: title, badges, metadata, button text, raw data."""
    strips = F.filter(
        F.transform("elements", lambda e, i: F.struct(e.alias("e"), i.alias("number"))),
        lambda s: (s["e"]["tag"] == "a") & (s["e"]["component"] == "offer_strip"))

    def row(s: Column) -> Column:
        element, first, last = s["e"], s["e"]["first"], s["e"]["last"]
        titles = F.transform(_inside(first, last, "h3"), lambda e: joined_text(e["first"], e["last"]))
        notes = F.struct(
            element["x_data"].alias("x_data"), F.get(titles, F.lit(0)).alias("title"),
            _texts(_inside(first, last, "span")).alias("badges"),
            _texts(_inside(first, last, "div")).alias("metadata"),
            joined_text(first, last).alias("all_text"))
        html = F.substring(F.col("html"), element["start"] + 1, element["stop"] - element["start"])
        return line_struct(s["number"], F.lit(0), mark(s["number"]), html, notes=notes)

    store = F.coalesce(store_from_site_heading(first_text("h1")), F.lit(V.UNKNOWN_STORE))
    return tokens, store, F.transform(strips, row)


def offer_type() -> Column:
    """First rule that applies, from the title, the badges, the button, the raw data."""
    title = fold(F.coalesce(normalize_plain(F.col("title")), F.lit("")))
    button = F.lower(F.col("all_text"))
    return (
        F.when(title.contains("free shipping"), "SHIPPING")
        .when(hit(title, V.BOGO), "BOGO")
        .when(F.exists("badges", lambda b: F.lower(b).contains("online cash back")), "REWARD")
        .when(F.exists("badges", lambda b: F.lower(b) == "code")
              | button.contains("show code"), "COUPON")
        .when(button.contains("get deal"), "SALE")
        .otherwise(some(grab(F.col("x_data"), V.SITE_RAW_TYPE)))
    )


def min_spend(offer: Column) -> Column:
    second = grab(offer, V.SITE_AMOUNT_OFF_MIN_SPEND, flags="(?iu)")
    named = grab(offer, V.SITE_MIN_SPEND, flags="(?iu)")
    return F.when(second != "", F.concat(F.lit("$"), second)).otherwise(some(named))


def _first_of(texts: str, pattern: str) -> Column:
    found = F.transform(texts, lambda text: grab(text, pattern, flags="(?iu)"))
    return F.get(F.filter(found, lambda text: text != ""), F.lit(0))


def with_site_fields(strips: DataFrame) -> DataFrame:
    """Candidate fields of strips that have ``offer``; works on titles alone as well."""
    offer = F.col("offer")
    flags = "(?iu)"
    fields = strips.withColumns({
        "max_discount_amount": some(grab(offer, V.UP_TO_AMOUNT_OFF, flags=flags)),
        "discount_percent": to_number(grab(offer, V.PERCENT_OFF, flags=flags)),
        "min_spend": min_spend(offer),
    })
    return fields.withColumns({
        "discount_amount": F.when(
            F.col("max_discount_amount").isNull(),
            some(grab(offer, V.AMOUNT_OFF, flags=flags))),
        "discount_type": F.when(F.col("max_discount_amount").isNotNull(), "upto"),
    })


def candidates_of_strips(rows: DataFrame) -> DataFrame:
    """Scored and deduplicated offers of the strips; never sets a coupon code."""
    strips = rows.select("page_id", "store", "ord_hi", "raw_html", "notes.*").withColumns({
        "offer": clean_site_offer(F.col("title")), "offer_type": offer_type()})
    wanted = (
        F.col("title").isNotNull() & (F.col("offer") != "")
        & ~is_noise_site_offer(F.col("offer")))
    rows = keep_rows(strips, wanted, ("page_id", "store", "ord_hi", "raw_html"),
                     ("offer", "offer_type", "badges", "metadata"))
    notes = F.concat("badges", "metadata")
    fields = with_site_fields(rows.withColumn("_notes", notes)).withColumns({
        "source": F.lit(V.SITE),
        "coupon_code": F.lit(None).cast("string"),
        "cashback_percent": F.when(F.col("offer_type") == "REWARD", to_number(grab(
            F.concat_ws(" ", "_notes", "offer"), V.CASHBACK, flags="(?iu)"))),
        "_date": _first_of("_notes", V.SITE_EXPIRY_DATE),
        "_relative": _first_of("_notes", V.SITE_EXPIRY_RELATIVE),
        "ord_lo": F.lit(0).cast("bigint"),
        "normalized_line": F.col("offer"),
    }).withColumns({
        "expiry": F.coalesce("_date", "_relative"),
        "expiry_type": F.when(F.col("_date").isNotNull(), "date").when(
            F.col("_relative").isNotNull(), "relative"),
    })
    scored = with_score(fields, bonus=False)
    good = keep_rows(
        scored, F.col("confidence") >= V.SITE_MIN_CONFIDENCE,
        ("page_id", "ord_hi", "ord_lo"), CANDIDATE_FIELDS)
    return deduplicate(good)


site_candidates = LineExtractor(strip_lines, candidates_of_strips)
