"""User-defined extractors: own rules, shared scoring."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlode.operators.dedup import normalize_candidates
from offerlode.operators.lines import PASS_TEXT
from offerlode.operators.signals import CANDIDATE_FIELDS, with_score

TYPES = {
    "discount_percent": T.DoubleType(), "cashback_percent": T.DoubleType(),
    "confidence": T.DoubleType(), "reasons": T.ArrayType(T.StringType()),
}


def scored_candidates(rows: DataFrame, source: str) -> DataFrame:
    """Complete candidates from rows with page_id, store, offer and any other fields."""
    given = set(rows.columns)
    missing = {
        name: F.lit(None).cast(TYPES.get(name, T.StringType()))
        for name in CANDIDATE_FIELDS
        if name not in given and name not in ("confidence", "reasons")}
    missing["source"] = F.lit(source)
    missing["raw_html"] = F.col("raw_html") if "raw_html" in given else F.lit("")
    missing["normalized_line"] = F.col("offer")
    for name in ("ord_hi", "ord_lo"):
        if name not in given:
            missing[name] = F.lit(PASS_TEXT if name == "ord_hi" else 0).cast("bigint")
    tidy = normalize_candidates(rows.withColumns(missing))
    return with_score(tidy, bonus=False).select(
        "page_id", "ord_hi", "ord_lo", *CANDIDATE_FIELDS)


def custom_extractor(source: str, rule: Callable[[DataFrame], DataFrame]):
    """Extractor for ``Routes.register`` from a rule over cleaned pages."""
    return lambda kept: scored_candidates(rule(kept), source)
