"""Confidence score, its reasons, canonical keys and exact number formatting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions import values as V
from offerlode.functions.regex import SPACE, contains_any, hit, jvm
from offerlode.functions.text import collapse, fold, staged

COUPON_LIKE = ("COUPON", "REWARD")


def offer_has_amount_off(folded: Column) -> Column:
    return folded.contains("$") & hit(folded, V.AMOUNT_OFF)


def offer_has_bogo(folded: Column) -> Column:
    return contains_any(folded, ("buy", "bogo")) & hit(folded, V.BOGO)


def score_terms(folded: Column) -> list[tuple[Column, float, str]]:
    """(condition, points, reason) in the order in which they are added up.

    Uses the candidate columns of the row; ``folded`` is the case-folded offer text.
    """
    kind = F.col("offer_type")
    return [
        (kind == "COUPON", 0.15, "coupon"),
        (kind == "REWARD", 0.10, "reward"),
        (kind == "SALE", 0.05, "sale"),
        (kind == "SHIPPING", 0.12, "shipping"),
        (kind == "BOGO", 0.18, "bogo_type"),
        (F.col("discount_percent").isNotNull() | F.col("discount_amount").isNotNull()
         | offer_has_amount_off(folded), 0.22, "discount"),
        (F.col("cashback_percent").isNotNull(), 0.18, "cashback"),
        (F.col("max_discount_amount") != "", 0.08, "max_discount"),
        (F.col("min_spend") != "", 0.10, "min_spend"),
        (F.col("expiry_type") == "date", 0.12, "expiry_date"),
        (F.col("expiry_type") == "relative", 0.04, "expiry_relative"),
        (folded.contains("free shipping"), 0.14, "free_shipping"),
        (offer_has_bogo(folded), 0.14, "bogo"),
        (folded.contains("up to"), 0.06, "up_to"),
        (F.col("store") != "", 0.05, "store"),
        (kind.isin(*COUPON_LIKE), 0.05, "strong_dom_type"),
    ]


def confidence(terms: list[tuple[Column, float, str]]) -> Column:
    """Left-to-right double sum from the base; the order decides borderline rows."""
    total = F.lit(0.3)
    for condition, points, _ in terms:
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def reasons(terms: list[tuple[Column, float, str]]) -> Column:
    """Reasons of the terms that hold; none has a comma.

    Joined and split, which is compiled; a filter of an array is interpreted.
    """
    held = F.concat_ws(",", *[
        F.when(condition, F.lit(reason)) for condition, _, reason in terms])
    return F.array_remove(F.split(held, ","), "")


# --- exact rounding and formatting ------------------------------------------------

TWO_54 = 1 << 54


def mean_confidence(unit_sum: Column, count: Column) -> Column:
    """Half-even mean to two digits; ``unit_sum`` adds confidences in units of 2^-54."""
    mean = unit_sum.cast("double") / F.lit(float(TWO_54)) / count
    hundred = (mean * F.lit(float(TWO_54))).cast("bigint") * F.lit(100)
    return _half_even(hundred, TWO_54) / F.lit(100.0)


def _half_even(value: Column, unit: int) -> Column:
    """Nearest multiple count of ``unit``, a power of two; integer arithmetic only."""
    rest = F.pmod(value, F.lit(unit))
    whole = ((value - rest) / F.lit(float(unit))).cast("bigint")
    half = F.lit(unit // 2)
    up = (rest > half) | ((rest == half) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + F.when(up, 1).otherwise(0)


def confidence_units(conf: Column) -> Column:
    return (conf * F.lit(float(TWO_54))).cast("bigint")


def round_tenth(value: Column) -> Column:
    """One digit, half-even on the binary value."""
    return round_digits(value, 1)


def round_digits(value: Column, digits: int) -> Column:
    """Half-even on the exact binary value, of any size.

    The whole part is kept apart, so the fraction is exact in units of 2^-60; the digits are
    counted in decimals, which hold the product.
    """
    unit, scale = 1 << 60, 10 ** digits
    whole = F.floor(value)
    part = ((value - whole) * F.lit(float(unit))).cast("bigint").cast("decimal(38,0)") * F.lit(scale)
    one = F.lit(unit).cast("decimal(38,0)")
    rest = part % one
    count = ((part - rest) / one).cast("bigint")
    up = (rest * 2 > one) | ((rest * 2 == one) & (F.pmod(whole * scale + count, F.lit(2)) == 1))
    return (whole * scale + count + F.when(up, 1).otherwise(0)) / F.lit(float(scale))


def format_short(value: Column) -> Column:
    """Up to six significant digits, no trailing zeros, exponent form outside range."""
    plain = value.cast("string")
    simple = F.regexp_replace(plain, r"\.0$", "")
    science = F.format_string("%.5e", F.abs(value))
    digits = F.regexp_replace(F.substring(science, 1, 7), r"\.", "")
    power = F.regexp_extract(science, r"e(.*)$", 1).try_cast("int")
    whole = F.when(power >= 0, F.left(digits, power + 1)).otherwise(F.lit("0"))
    part = F.when(power >= 0, F.substr(digits, power + 2)).otherwise(
        F.concat(F.repeat(F.lit("0"), -power - 1), digits))
    fixed = F.concat(whole, F.lit("."), part)
    scaled = F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))
    trim_zeros = [
        F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
        for text in (fixed, scaled)
    ]
    exponent = F.concat(
        F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.format_string("%02d", F.abs(power)))
    general = F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.when(power.between(-4, 5), trim_zeros[0]).otherwise(
            F.concat(trim_zeros[1], exponent)))
    short = plain.rlike(r"^-?[0-9]{1,3}(\.[0-9]{1,3})?$")
    return F.when(value.isNotNull(), F.when(short, simple).otherwise(general))


def two_digits(value: Column) -> Column:
    """Half up on the shortest decimal form; a decimal does the same as the slow formatter."""
    small = (value > 0) & (value < 1e6)
    return F.when(small, value.cast("decimal(9,2)").cast("string")).when(
        value.isNotNull(), F.format_string("%.2f", value))


# --- deduplication keys -----------------------------------------------------------

def _escape_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def same_text_key(offer: Column) -> Column:
    return F.btrim(collapse(F.lower(offer)))


def with_canonical_key(df: DataFrame, key: str, offer: Column) -> DataFrame:
    """Lower-case offer without lead-ins, its numbers replaced by the parsed ones."""
    percent, amount = F.col("discount_percent"), F.col("discount_amount")
    lead_in = jvm(V.KEY_LEAD_INS, SPACE)
    percent_text = F.concat(format_short(percent), F.lit("% off"))
    amount_text = F.concat(_escape_replacement(F.lower(amount)), F.lit(" off"))
    return staged(
        df.withColumn(key, F.lower(offer)), key,
        lambda c: F.when(c.rlike("^[flt]"), F.regexp_replace(c, lead_in, "")).otherwise(c),
        lambda c: F.btrim(collapse(c)),
        lambda c: F.when(
            percent.isNotNull() & c.contains("% "),
            F.regexp_replace(c, F.lit(jvm(V.KEY_PERCENT_OFF)), percent_text)).otherwise(c),
        lambda c: F.when(
            (amount != "") & c.contains("$"),
            F.regexp_replace(c, F.lit(jvm(V.KEY_AMOUNT_OFF)), amount_text)).otherwise(c),
    )


def best_offer_text(offer: Column, normalized_line: Column) -> Column:
    return F.coalesce(F.nullif(offer, F.lit("")), normalized_line)


def folded_offer() -> Column:
    return fold(F.coalesce(F.col("offer"), F.lit("")))
