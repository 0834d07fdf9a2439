"""Plans of the line detectors: how many projections they take, and that the JVM compiles them."""

import html
import json
import re

import pytest
from pyspark.sql import functions as F

from offerlode.functions.scoring import reasons, two_digits
from offerlode.functions.text import collapse, decode_entities, fold, is_packed, to_number, visible
from offerlode.operators import report
from offerlode.operators.dedup import deduplicate, rank_and_filter
from offerlode.operators.lines import offer_lines as offer_parts
from offerlode.operators.signals import with_folded, with_signals
from offerlode.plans import offers as plans
from offerlode.queries.registry import QUERIES
from offerlode.session import COMPILED, compiled, sharing
from offerlode.sinks.render import json_text, json_texts
from offerlode.sources.tables import offer_lines

#: Steps of the longest chain of detector columns that read each other.
PROJECTIONS = 14


def test_detectors_take_few_projections(spark):
    lines = with_folded(spark.range(1).select(F.col("id").cast("string").alias("offer")))
    plan = with_signals(lines)._jdf.queryExecution().analyzed().toString()
    assert sum("Project [" in line for line in plan.split("\n")) <= PROJECTIONS


def test_offer_lines_lower_the_method_limit(spark, small):
    key, limit = COMPILED
    try:
        spark.conf.set(key, "65535")
        offer_lines(spark, small)
        assert spark.conf.get(key) == limit
        spark.conf.set(key, "4000")
        compiled(spark)
        assert spark.conf.get(key) == "4000"
    finally:
        spark.conf.set(key, limit)


def test_percents_and_codes_keep_their_order(spark):
    rows = {
        "额外9折 20% off": ("p_zh_extra", 10.0), "20% off 低至3折": ("p_direct", 20.0),
        "up to 30%off 低至3折": ("p_upto", 30.0), "extra 15%off, 5折": ("p_extra", 15.0),
        "低至3折 8% 할인": ("p_zh_low", 70.0), "7折 8% 할인": ("p_zhe", 30.0),
        "8% 할인 9%オフ": ("p_korean", 8.0), "9%オフ 7% descuento": ("p_japanese", 9.0),
        "7% descuento": ("p_spanish", 7.0),
    }
    found = {row["offer"]: row for row in with_signals(with_folded(
        spark.createDataFrame([(text,) for text in rows], "offer string"))).collect()}
    assert {text: (step, found[text][step], found[text]["discount_percent"])
            for text, (step, _) in rows.items()} == {
        text: (step, value, value) for text, (step, value) in rows.items()}
    coded = spark.createDataFrame(
        [("code ABC12 优惠码 ZH345 쿠폰 KO678",), ("쿠폰 KO678 クーポン JA901",)], "offer string")
    assert [row["coupon_code"] for row in with_signals(with_folded(coded)).collect()] == ["ZH345", "KO678"]


def test_quick_tests_miss_no_character(spark):
    texts = ["a\tb", "a\x1cb", "a\x85b", "a\xa0b", "a b", "a b", "a　b", "a  b", "折 é",
             "ſıİKÉ", "É", "a​b", "a•b", "a·b", "a|b", "ab", "\U0001f600 x"]
    rows = spark.createDataFrame([(text,) for text in texts], "t string").select(
        collapse(F.col("t")), fold(F.col("t")), visible(F.col("t")), is_packed(F.col("t"))).collect()
    assert [row[0] for row in rows[:8]] == ["a b"] * 8
    assert [row[0] for row in rows[8:]] == texts[8:]
    assert rows[9][1] == "siiké" and rows[10][1] == "é"
    assert rows[3][2] == "a b" and rows[11][2] == "ab"
    assert [row[3] for row in rows].count(True) == 3


def test_captures_without_a_match_are_not_cast(spark):
    """Casting the empty text raises and catches an error inside; most captures are empty."""
    texts = spark.createDataFrame([("12.5",), ("\u0663",), ("",), (None,), ("x",)], "t string")
    numbers = texts.select(to_number(F.col("t")).alias("n"))
    assert [row["n"] for row in numbers.collect()] == [12.5, 3.0, None, None, None]
    plan = numbers._jdf.queryExecution().analyzed().toString()
    assert plan.index("NOT (t#") < plan.index("try_cast(")


def test_references_are_looked_up_only_where_there_is_one(spark):
    """A token without ``&`` runs none of the patterns of a reference."""
    texts = ["Save 20% &nbsp;now", "&notit; &notin;", "&#65;&#x41;&#128;&#0;", "&unknown; & &amp;lt;",
             "&#99999999999999999999;", "a & b", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", decode_entities(F.col("t")).alias("t"))
    assert [row["t"] for row in rows.orderBy("i").collect()] == [
        None if text is None else html.unescape(text) for text in texts]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "&#" in plan and plan.index("NOT StartsWith(") < plan.index("regexp_extract(")


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_plain_texts_skip_the_json_writer(spark):
    texts = ["a", 'q"q', "a\\b", "a\nb", "折 é", "", None]
    rows = spark.createDataFrame([(text, [text, "b"]) for text in texts], "t string, ts array<string>")
    quoted = [json.dumps(text, ensure_ascii=False) for text in texts]
    found = rows.select(json_text(F.col("t")).alias("one"), json_texts(F.col("ts"), ",\n").alias("all"))
    assert [tuple(row) for row in found.collect()] == [(text, f'{text},\n"b"') for text in quoted]
    plan = _plan(found.select("one"))
    assert plan.index("RLIKE(") < plan.index("to_json(")


def test_reasons_are_compiled(spark):
    rows = spark.createDataFrame([(True, None), (None, False), (True, True)], "a boolean, b boolean")
    found = rows.select(reasons([(F.col("a"), 0.1, "x"), (F.col("b"), 0.2, "y")]).alias("r"))
    assert [row["r"] for row in found.collect()] == [["x"], [], ["x", "y"]]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_two_digits_need_no_formatter_for_scores(spark):
    values = [0.005, 0.015, 0.9, 1.0, 0.0, -0.0, -1.5, 2.675, 999999.995, 1e6, 1e20, float("nan"), None]
    rows = spark.createDataFrame([(value,) for value in values], "v double").select(
        two_digits(F.col("v")).alias("ours"),
        F.when(F.col("v").isNotNull(), F.format_string("%.2f", "v")).alias("formatter"))
    assert all(row["ours"] == row["formatter"] for row in rows.collect())
    plan = _plan(rows.select("ours"))
    assert plan.index("decimal(9,2)") < plan.index("format_string(")


def test_lines_left_alone_are_folded_once(spark):
    texts = ["20% off Show Code", "SAVE 20% OFF ſhoes", "Envío 20% É", "a &amp; 20%", "10% İ", "why 20% off"]
    parts = spark.createDataFrame([(text,) for text in texts], "part string")
    kept = offer_parts(parts)
    assert {(row["offer"], row["fold"]) for row in kept.collect()} == {
        ("20% off", "20% off"), ("SAVE 20% OFF ſhoes", "save 20% off shoes"),
        ("Envío 20% É", "envío 20% é"), ("a & 20%", "a & 20%"), ("10% İ", "10% i")}
    assert re.search(r"ELSE _left_fold#\d+ END AS low#", _plan(kept))


def test_page_summaries_read_the_candidates_once(spark):
    """Counts and means come from one aggregate on (page, score); no row of an offer is sorted."""
    scores = {1: [0.9] * 3 + [0.5] * 4, 2: [0.41, None], 3: [None], 4: [0.3, 0.95, 0.35, 0.85, 0.65, 0.75], None: [0.7]}
    found = spark.createDataFrame(
        [(page, score, number % 3, number, "20% off") for page, held in scores.items() for number, score in enumerate(held)],
        "page_id long, confidence double, ord_hi int, ord_lo int, offer string")
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,), (None,)], "page_id long")
    summaries = report.page_summaries(pages, found)
    assert sorted((row["page_id"] or 0, row["candidate_count"], row["overall_confidence"]) for row in summaries.collect()) == [
        (0, 0, 0.0), (1, 7, 0.74), (2, 2, 0.2), (3, 1, 0.0), (4, 6, 0.71), (5, 0, 0.0), (5, 0, 0.0)]
    means = {row["page_id"]: row["overall_confidence"] for row in report.page_confidence(found).collect()}
    assert means == {1: 0.74, 2: 0.2, 3: None, 4: 0.71, None: 0.7}
    plan = summaries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("ord_lo") == 1


def test_fallback_queries_store_no_offers(spark, small):
    for name in ("fallback_gate", "fallback_enrich"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" not in plan


#: The queries that rank the offers of the derived lines.
RANKED = ("rank_filter", "page_report", "render_text", "render_json")


def _plain_offers(lines, keep):
    """Stands in for the parser: every line is an offer."""
    texts = ("offer_type", "coupon_code", "discount_amount", "max_discount_amount", "min_spend",
             "discount_type", "expiry", "expiry_type", "raw_html")
    return lines.select(
        *keep, "store", "offer", F.lit("generic").alias("source"),
        *[F.lit(None).cast("string").alias(name) for name in texts],
        *[F.lit(None).cast("double").alias(name) for name in ("discount_percent", "cashback_percent")],
        (F.lit(0.3) + F.length("offer") % 5 / 10).alias("confidence"), F.array("store").alias("reasons"),
        F.col("offer").alias("normalized_line"))


@pytest.fixture
def plain_parser(monkeypatch):
    monkeypatch.setattr(plans.L, "explode_parts", lambda lines: lines.select(
        "page_id", "line_id", F.lit(0).alias("part_no"), F.col("line").alias("offer")))
    monkeypatch.setattr(plans.L, "offer_lines", lambda parts: parts)
    monkeypatch.setattr(plans, "parse_offers", _plain_offers)


@pytest.mark.parametrize("name", RANKED)
def test_ranked_queries_shuffle_the_offers_once(spark, small, plain_parser, name):
    """No offers are kept; behind the parser they are shuffled once, for all that read them."""
    with sharing():
        found = QUERIES[name](spark, small)
        assert "InMemoryRelation" not in found._jdf.queryExecution().withCachedData().toString()
        assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "Reused" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in made) == 1
    assert sum("offer" in line for line in made) <= 1  # by page and text, before the parser


@pytest.mark.parametrize("large_page", [0, 8, 10_000])
def test_ranks_of_small_and_large_pages(spark, plain_parser, large_page):
    texts = [f"{'x' * (n % 7)} item {n % 23} {'Off' if n % 2 else ' off'}" for n in range(40)]
    lines = [(page, n, texts[n % 40]) for page, count in ((1, 60), (2, 5), (None, 30)) for n in range(count)]
    given = spark.createDataFrame(lines, "page_id long, line_id long, line string")
    args = given, F.shiftleft("line_id", 10) + F.col("part_no"), F.lit("Shop")
    offers, ranked = plans.ranked_from_lines(*args, large_page)
    plain = rank_and_filter(deduplicate(plans.candidates_from_lines(*args)))
    want = {}
    for row in plain.collect():
        want.setdefault(row["page_id"], []).append((-row["confidence"], row["ord_hi"], row["ord_lo"], row["offer"]))
    assert set(want) == {1, 2, None} and len(want[1]) > 8 > len(want[2])
    got = {}
    for row in ranked.collect():
        got.setdefault(row["page_id"], []).append((row["rank"], row["page_total"], row["offer"]))
    assert {page: sorted(held) for page, held in got.items()} == {
        page: [(at, len(held), one[3]) for at, one in enumerate(sorted(held), 1)] for page, held in want.items()}
    assert sorted(map(str, offers.collect())) == sorted(map(str, plain.select(offers.columns).collect()))
