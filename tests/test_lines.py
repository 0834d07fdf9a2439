"""Single lines and text pages with the rows they must give."""

import html
import re

import pytest
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions import text as X
from offerlode.functions import values as V
from offerlode.operators import report
from offerlode.operators.dedup import deduplicate, rank_and_filter
from offerlode.plans.pages import text_candidates

PAGE = """
    Lantern & Loom autumn list
    Take 35% off every wool rug with code RUGS35.
    Garden lamps: $40 off when the set is ordered.
    Free shipping on parcels to Norway.
    Card holders earn 6% cash back on linen.
    Buy 4, Get 2 free on tea lights.
    Latest arrivals are on the second floor.
    Contact support at desk@loom.example.
"""
DEALER = "https://rabatt.example/shop/iron-kettle.html"
# (line, url, expected values of the only candidate; None: no candidate)
LINES = [
    ("Oak chairs 45% off, code CHAIR45, ends June 3, 2027.", "https://wood.example",
     {"expiry": "June 3, 2027", "expiry_type": "date", "coupon_code": "CHAIR45", "store": "Wood"}),
    ("会员额外7折", DEALER, {"discount_percent": 30.0, "store": "Iron Kettle"}),
    ("茶具 8%返利", DEALER, {"cashback_percent": 8.0}),
    ("折扣码 TEA77 周末有效", DEALER, {"coupon_code": "TEA77"}),
    ("全国免运费", DEALER, {"offer_type": "SHIPPING"}),
    ("满900减120", DEALER, {"min_spend": "900", "discount_amount": "120"}),
    ("低至2折 瓷器", DEALER, {"discount_percent": 80.0}),
    ("买3赠2 茶杯", DEALER, {"offer_type": "BOGO"}),
    ("周末大促 欢迎", DEALER, None),
    ("찻잔 45% 세일", "https://cup.example", {"discount_percent": 45.0}),
    ("急須 35%引き", "https://cup.example", {"discount_percent": 35.0}),
    ("Teteras 55% dto en otoño", "https://cup.example", {"discount_percent": 55.0}),
    ("Envío gratuito a toda la isla", "https://cup.example", {"offer_type": "SHIPPING"}),
    ("65% off kettles", DEALER, {"store": "Iron Kettle"}),
    ("hi", "", None),
    ("", "", None),
    ("Save $1,299 today", "", {"discount_amount": "$1"}),
    ("$1,299 off", "", None),
    ("12.5%off", "", {"discount_percent": 5.0}),
    ("up to 50% off", "", {"discount_percent": 50.0, "discount_type": None}),
    ("up to 50%off", "", {"discount_percent": 50.0, "discount_type": "upto"}),
    ("额外15折", "", {"discount_percent": -50.0}),
    ("use code at checkout, code SAVE20", "", None),
    ("on 5 items 20% off", "", {"min_spend": "5"}),
    ("Up to $50 off", "", {"discount_amount": None, "max_discount_amount": "$50",
                           "confidence": 0.3 + 0.05 + 0.22 + 0.08 + 0.06 + 0.05}),
    ("２０% off full-width", "", {"discount_percent": 20.0}),
    ("8.555折", "", {"discount_percent": round((10 - 8.555) * 10, 1)}),
    ("20% off全场", "", {"discount_percent": 20.0}),
    ("10% off &amp;amp; more&nbsp;", "", {"offer": "10% off & more"}),
    ("Show verified code 15% OFF", "", {"offer": "15% OFF"}),
]


@pytest.fixture(scope="module")
def line_rows(spark):
    pages = spark.createDataFrame(
        [(i, url, line) for i, (line, url, _) in enumerate(LINES)],
        "page_id bigint, url string, text string")
    found = {}
    for row in text_candidates(pages).collect():
        found.setdefault(row["page_id"], []).append(row.asDict())
    return found


@pytest.mark.parametrize("number", range(len(LINES)))
def test_line(line_rows, number):
    expected = LINES[number][2]
    rows = line_rows.get(number, [])
    if expected is None:
        assert rows == []
        return
    assert len(rows) == 1
    assert {name: rows[0][name] for name in expected} == expected


def test_text_page(spark):
    pages = spark.createDataFrame(
        [(1, "https://example.com", PAGE), (2, "https://example.com", " \n ")],
        "page_id bigint, url string, text string")
    offers = rank_and_filter(deduplicate(text_candidates(pages))).cache()
    rows = {r["offer"]: r for r in offers.collect()}
    assert {o: (r["offer_type"], round(r["confidence"], 2)) for o, r in rows.items()} == {
        "Take 35% off every wool rug with code RUGS35.": ("COUPON", 0.85),
        "Card holders earn 6% cash back on linen.": ("REWARD", 0.68),
        "Garden lamps: $40 off when the set is ordered.": ("SALE", 0.62),
        "Buy 4, Get 2 free on tea lights.": ("BOGO", 0.67),
        "Free shipping on parcels to Norway.": ("SHIPPING", 0.61),
    }
    assert {r["store"] for r in rows.values()} == {"Example"}
    assert {r["source"] for r in rows.values()} == {"generic"}
    summary = {r["page_id"]: r for r in report.page_summaries(
        pages.select("page_id"), offers).collect()}
    assert summary[1]["overall_confidence"] == 0.69
    assert summary[2]["candidate_count"] == 0 and summary[2]["overall_confidence"] == 0.0


def test_entities(spark):
    samples = [
        "a &amp; b &copy; &eacute x &notit; &#65;&#x41; &#128; &zzz; & &#0; &#xD800; &#11;",
        "&CounterClockwiseContourIntegral; &lt;b&gt; &#99999999999999999999; &ampamp; &;",
        "no references", "&#x1F600; &#x; &nbsp;|", "&Aacute;&aacute &not;in; &notin; &fjlig;",
    ]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", X.decode_entities(F.col("s")).alias("d")).collect()
    assert [r["d"] for r in rows] == [html.unescape(r["s"]) for r in rows]


def test_number_formats(spark):
    values = [20.0, 12.5, -50.0, 0.1, 33.3333333, 1234567.0, 0.00001234, 100.0, 99.95, 1e10]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", S.format_short(F.col("v")).alias("g"), S.two_digits(F.col("v")).alias("f"))
    for row in rows.collect():
        assert row["g"] == f"{row['v']:g}"


def test_round_tenth(spark):
    values = [(10 - z / 1000) * 10 for z in range(1, 15000, 7)] + [-50.0, 14.45]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", S.round_tenth(F.col("v")).alias("r")).collect()
    assert [r["v"] for r in rows if r["r"] != round(r["v"], 1)] == []


def test_title_and_codes(spark):
    rows = spark.createDataFrame(
        [("55haitao o'neil",), ("MICHAEL kors2u",)], "s string").select(
        "s", X.title_case(F.col("s")).alias("t")).collect()
    assert all(row["t"] == row["s"].title() for row in rows)
    codes = {" save20. ": "SAVE20", "code": None, "12345": None, "2026-04-21": None,
             "abcd": None, "abcde": "ABCDE", "A-1": "A-1", "x": None}
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(
        "c", X.valid_code(F.col("c")).alias("k")).collect()
    assert {row["c"]: row["k"] for row in got} == codes


def test_noise_lists_match_words(spark):
    for phrase in V.NOISE_PHRASES:
        assert phrase == phrase.lower() and not re.search(r"\s{2}", phrase)
