"""Rules that shared constants could hide: each is checked against Python itself."""

import random

import pytest
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions.tokenizer import record
from offerlode.operators.signals import capture_steps, may_have_signal, percent_steps, with_folded
from offerlode.sources.pages import page_error
from offerlode.sources.url_lists import url_list

PLAIN = ["Envio gratis en pedidos", "codigo: AHORRO20 en zapatos", "cupom: DESC20 na loja", "cupon AHORRO20 hoy"]
SEEDS = PLAIN + [
    "Envío gratuito hoy", "CÓDIGO: VERANO10", "Cupón: SOL2024", "20% de descuento", "free shipping on all", "Buy 2, get 1 free",
    "Save $15 now", "up to 40% off", "extra 10% off", "5% cash back", "use code HELLO10", "优惠码 EXTRA10", "额外9折", "满200减50",
    "最高5%返利", "包邮", "买1送1", "쿠폰 KOR10", "30% 할인", "무료 배송", "クーポン：JPN10", "最大50%オフ", "送料無料", "BOGO shoes",
]


def variants():
    rnd = random.Random(0)
    plain = str.maketrans("áéíóúÁÉÍÓÚ", "aeiouAEIOU")
    for line in SEEDS:
        for base in (line, line.translate(plain), line.upper(), line.lower(), line.title()):
            yield base
            yield "".join(c.upper() if rnd.random() < 0.5 else c.lower() for c in base) + rnd.choice(["", " x", " é"])


def test_gate_never_hides_a_signal(spark):
    lines = sorted(set(variants()))
    frame = with_folded(spark.createDataFrame([(line,) for line in lines], "offer string"))
    steps = {**capture_steps(), **percent_steps()}
    # Words that only hint at a deal are no signal of their own.
    fired = [name for name in steps if name[:2] in ("c_", "m_") and name not in ("m_word", "m_zh_word")]
    found = frame.withColumn("gate", may_have_signal(F.col("fold"))).select(
        "offer", "gate", *[step.alias(name) for name, step in steps.items()]
    ).select("offer", "gate", F.greatest(F.lit(False), *[
        F.coalesce(F.col(name), F.lit(False)) if name[0] == "m" else F.col(name).isNotNull() for name in fired
    ]).alias("fires")).collect()
    assert not [row.offer for row in found if row.fires and not row.gate]
    assert all(row.gate for row in found if row.offer in PLAIN)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_rounding_equals_python(spark, digits):
    rnd = random.Random(1)
    values = [1 / 8, 1 / 16 * 100, 0.005, 2.675, 1000.25, -1000.05, -1000.25, 0.05, 12345678.05, -0.5, 0.0, 2.5, 1e12 + 0.25]
    values += [rnd.randint(0, 4000) / rnd.choice([1, 3, 8, 16, 200, 1000]) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", S.round_digits(F.col("v"), digits).alias("r")).collect()
    assert [(row.v, row.r) for row in got] == [(v, round(v, digits)) for v in values]


def test_page_errors_name_the_normalised_url(spark):
    rows = [("  shop.example.com/a ", "", None), ("https://a.example.com", "<p>x</p>", "broken"), (" ", "x", None)]
    frame = spark.createDataFrame(rows, "url string, html string, error string")
    got = frame.select(page_error(F.col("url"), F.lit(False), F.col("html"), F.col("error"))).collect()
    assert got[0][0].endswith("from https://shop.example.com/a.")
    assert got[1][0] == "broken" and got[2][0] is not None


def test_marked_sections_are_comments():
    for html in ("<p>20% off all</p><![foo[bar]]><p>x</p>", "<p>20% off all</p><![if !x]><p>x</p>"):
        page = record(html)
        assert page["error"] is None
        assert [event["text"] for event in page["events"] if event["kind"] == 1] == ["20% off all", "x"]
    assert record("<p>a</p><![open")["error"] is None


def test_headerless_list_keeps_its_first_row(spark):
    frame = spark.createDataFrame([("x", "b.example.com"), ("y", None)], ["n", "https://a.example.com/1"])
    got = sorted((row.row_number, row.url) for row in url_list(frame).collect())
    assert got == [(1, "https://a.example.com/1"), (2, "b.example.com")]
