"""Ranking, reports, output formats, URL lists, files and streams."""

import csv
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions import urls as U
from offerlode.functions import values as V
from offerlode.operators import batch, report
from offerlode.operators.custom import scored_candidates
from offerlode.operators.dedup import deduplicate, rank_and_filter, with_rank
from offerlode.plans.pages import default_routes
from offerlode.sinks import render, writers
from offerlode.sinks.packed import KINDS, read_document, read_index
from offerlode.sources.pages import decode_body, read_page_files, read_text_pages
from offerlode.sources.url_lists import UrlListError, number_rows, url_list
from offerlode.streaming.intake import page_stream, read_totals, run_totals, start_intake, start_totals


def offers(spark):
    rows = [
        (1, "TestStore", "20% Off Sitewide", "COUPON", 20.0, None),
        (1, "TestStore", "Free Shipping On \"$50+\"", "SHIPPING", None, "$50+"),
        (2, "Other", "10% off or 10% off", "SALE", 10.0, None),
        (2, "Other", "10% off or 30% off", "SALE", 10.0, None),
    ]
    given = spark.createDataFrame(
        rows, "page_id bigint, store string, offer string, offer_type string, "
              "discount_percent double, min_spend string")
    return scored_candidates(given.withColumn("ord_lo", F.monotonically_increasing_id()), "test")


def summaries(spark, found):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id bigint")
    return report.page_summaries(pages, found)


def test_scoring_and_canonical_duplicates(spark):
    rows = {r["offer"]: r for r in deduplicate(offers(spark)).collect()}
    assert set(rows) == {"20% Off Sitewide", 'Free Shipping On "$50+"', "10% off or 10% off"}
    assert rows["20% Off Sitewide"]["confidence"] == 0.3 + 0.15 + 0.22 + 0.05 + 0.05
    assert rows["20% Off Sitewide"]["reasons"] == [
        "coupon", "discount", "store", "strong_dom_type"]


RANKED = "page_id bigint, confidence double, ord_hi bigint, ord_lo bigint, offer string"


@pytest.mark.parametrize("large_page,stretches", [(10, 8), (10_000, 1_000)])
def test_ranks_equal_brute_force(spark, large_page, stretches):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.8 else rng.randrange(3), rng.choice([0.4, 0.62, 0.7, 0.91]),
             rng.randrange(2), rng.randrange(500), f"o{rng.randrange(10 ** 6)}")
            for _ in range(3000)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, RANKED)
    ranked = with_rank(df, total="total", large_page=large_page, stretches=stretches)
    got = {tuple(r[c] for c in df.columns): (r["rank"], r["total"]) for r in ranked.collect()}
    expected = {}
    for page in {row[0] for row in rows}:
        own = sorted((r for r in rows if r[0] == page), key=lambda r: (-r[1], *r[2:]))
        expected |= {row: (n, len(own)) for n, row in enumerate(own, 1)}
    assert got == expected


def test_ranks_of_a_page_with_200_000_offers(spark):
    """Text positions (line << 31) and container positions, a fifth of the page in one place."""
    n = 200_000
    rows = spark.range(n).select(
        F.lit(1).cast("bigint").alias("page_id"),
        (F.lit(0.4) + F.pmod(F.col("id") * 7919, F.lit(4)) / 10).alias("confidence"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(1 << 40).alias("ord_hi"),
        F.when(F.col("id") % 5 == 0, 7).otherwise(F.shiftleft(F.col("id"), 31)).alias("ord_lo"),
        F.format_string("offer %07d", F.pmod(F.col("id") * 104729, F.lit(n))).alias("offer"))
    ranked = with_rank(rows, total="total").select("*").toPandas()
    order = ranked.sort_values(
        ["confidence", "ord_hi", "ord_lo", "offer"], ascending=[False, True, True, True])
    assert order["rank"].tolist() == list(range(1, n + 1)) and set(ranked["total"]) == {n}
    best = rank_and_filter(rows, max_results=1500).select("offer").collect()
    assert {r["offer"] for r in best} == set(order["offer"][:1500])


def test_mean_confidence_is_exact(spark):
    rng = random.Random(5)
    groups = [[round(rng.randrange(30, 100) / 100 + rng.choice([0, 1e-16]), 17)
               for _ in range(rng.randrange(1, 6))] for _ in range(2000)]
    df = spark.createDataFrame(
        [(g, c) for g, values in enumerate(groups) for c in values], "g int, c double")
    got = df.groupBy("g").agg(S.mean_confidence(
        F.sum(S.confidence_units(F.col("c"))), F.count("*")).alias("m")).collect()
    assert all(r["m"] == round(sum(groups[r["g"]]) / len(groups[r["g"]]), 2) for r in got)


def document(fragments, page):
    rows = sorted((r["seq"], r["text"]) for r in fragments.collect() if r["page_id"] == page)
    return "\n".join(text for _, text in rows) + "\n"


def test_text_and_json_reports(spark):
    found = deduplicate(offers(spark))
    pages = summaries(spark, found)
    answers = spark.createDataFrame(
        [(3, " A | 5% off | NO_CODE | none ", None)],
        "page_id bigint, response_text string, response_error string")
    pages = report.with_fallback_results(pages, answers)
    text = render.text_report(pages, found)
    assert document(text, 3) == (
        "OVERALL_CONFIDENCE=0.00\nUSED_LLM_FALLBACK=yes\nHEURISTIC_CANDIDATES\n"
        "NO_DEALS_FOUND\nLLM_FALLBACK_OUTPUT\nA | 5% off | NO_CODE | none\n")
    assert "TestStore | 20% Off Sitewide | COUPON | type=coupon, discount=20%, confidence=0.77" \
        in document(text, 1)
    reports = render.json_report(pages, found)
    data = json.loads(document(reports, 1))
    assert data["candidate_count"] == 2 and len(data["candidates"]) == 2
    assert document(reports, 1) == json.dumps(data, indent=2, ensure_ascii=False) + "\n"
    assert json.loads(document(reports, 3))["llm_fallback_output"].startswith("A | 5%")
    assert json.loads(document(reports, 3))["candidates"] == []


def test_long_reports_continue_in_chunks(spark):
    found = deduplicate(offers(spark))
    rows = report.page_reports(summaries(spark, found), found, chunk=1).collect()
    assert sorted((r["page_id"], r["chunk"], len(r["candidates"])) for r in rows) == [
        (1, 0, 1), (1, 1, 1), (2, 0, 1), (3, 0, 0)]


def test_writers(spark, tmp_path):
    found = deduplicate(offers(spark))
    pages = summaries(spark, found)
    with pytest.raises(ValueError, match="Unknown output format"):
        writers.output_format("xml")
    writers.write_reports(pages, found, "CSV", f"{tmp_path}/csv")
    lines = [row for name in glob.glob(f"{tmp_path}/csv/*.csv")
             for row in csv.DictReader(open(name, encoding="utf-8"))]
    assert {row["offer"] for row in lines} >= {'Free Shipping On "$50+"'}
    assert {row["discount_percent"] for row in lines} == {"20.0", "", "10.0"}


def joined(spark, folder, stem, kind):
    return "\n".join(row["text"] for row in read_document(spark, folder, stem, kind).collect())


def test_packed_outputs_hold_every_document(spark, tmp_path):
    rows = [(n, f"https://shop{n}.example.com", f"<html><body><p>{n}% off bags</p></body></html>") for n in range(1, 41)]
    rows.append((41, "https://shop41.example.com", "<p>" + "<br>".join(f"{n % 90}% off thing {n}" for n in range(3000)) + "</p>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    keys = pages.select("page_id", F.format_string("row_%05d", "page_id").alias("output_stem"))
    found = batch.run_batch(pages, default_routes(), contents=True)
    offers = found.offers().cache()
    reports = writers.report_fragments(report.page_summaries(found.records, offers), offers, "text")
    folder = f"{tmp_path}/out"
    writers.write_page_outputs(found.records, keys, folder, reports)
    assert not glob.glob(f"{folder}/files/*=*")
    for n in (1, 17, 40):
        assert joined(spark, folder, f"row_{n:05d}", "text") == f"{n}% off bags"
        assert joined(spark, folder, f"row_{n:05d}", "html") == f"<body><p>{n}% off bags</p></body>"
        assert joined(spark, folder, f"row_{n:05d}", "deals").startswith("OVERALL_CONFIDENCE=0.")
    assert joined(spark, folder, "row_00041", "deals").count("\n") > 1000
    assert joined(spark, folder, "row_99999", "deals") == ""
    index = read_index(spark, folder).collect()
    assert sum(row["rows"] for row in index) == spark.read.parquet(f"{folder}/files").count()
    assert {(row["output_stem"], row["kind"]) for row in index} == {
        (f"row_{n:05d}", kind) for n in range(1, 42) for kind in KINDS}


def test_csv_documents_equal_the_csv_module(spark, tmp_path):
    found = deduplicate(offers(spark))
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id bigint, output_stem string")
    writers.write_reports(summaries(spark, found), found, "csv", f"{tmp_path}/csv", keys=keys)
    rows = list(csv.DictReader(joined(spark, f"{tmp_path}/csv", "a", "deals").split("\n")))
    assert tuple(rows[0]) == V.CSV_FIELDS
    assert [row["offer"] for row in rows] == ["20% Off Sitewide", 'Free Shipping On "$50+"']
    assert rows[1]["discount_percent"] == "" and rows[0]["discount_percent"] == "20.0"
    assert joined(spark, f"{tmp_path}/csv", "c", "deals") == ",".join(V.CSV_FIELDS)


def test_url_lists(spark, tmp_path):
    table = spark.createDataFrame(
        [("a", " https://a.com "), ("b", None), ("c", "b.com")], ["Name", "Page-URL"])
    rows = url_list(table.coalesce(1)).collect()
    assert [(r["row_number"], r["url"]) for r in rows] == [(2, "https://a.com"), (4, "b.com")]
    with pytest.raises(UrlListError, match="name, page_url"):
        url_list(table, "missing")
    bare = spark.createDataFrame([("/x", "a.com"), ("/y", "b.com")], ["_c0", "_c1"])
    assert [r["url"] for r in url_list(bare.coalesce(1), header=False).collect()] == [
        "a.com", "b.com"]
    spark.range(0, 50).selectExpr("id", "concat('s', id, '.example.com') as url").coalesce(1).write.parquet(f"{tmp_path}/list")
    filed = url_list(spark.read.parquet(f"{tmp_path}/list"))
    assert [r["row_number"] for r in filed.orderBy("row_number").collect()] == list(range(2, 52))
    plan = filed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    numbered = number_rows(spark.range(0, 100, 1, 7), 2).collect()
    assert sorted(r["row_number"] - r["id"] for r in numbered) == [2] * 100


def test_output_stem(spark):
    long_url = "https://example.com/" + "a" * 200
    rows = spark.createDataFrame(
        [(1, "example.com"), (42, long_url), (123456, "https://e.com/p?q=t&s=a"), (5, "??")],
        "n int, u string").select("n", U.output_stem(F.col("n"), F.col("u")).alias("s"))
    stems = {r["n"]: r["s"] for r in rows.collect()}
    assert stems[1] == "row_00001_example_com"
    assert len(stems[42]) == len("row_00042_") + 80
    assert stems[123456] == "row_123456_e_com_p_q_t_s_a" and stems[5] == "row_00005_url"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>caf\xe9</p>".encode("latin-1"))
    (tmp_path / "b.txt").write_text("x\ny")
    page = read_page_files(spark, f"{tmp_path}/a.html").first()
    assert page["html"] == "<p>caf�</p>"
    both = spark.createDataFrame(
        [(bytearray("é".encode("latin-1")), "latin-1"), (bytearray(), None)],
        "b binary, e string").select(decode_body(F.col("b"), F.col("e")).alias("t")).collect()
    assert [r["t"] for r in both] == ["é", ""]
    assert read_text_pages(spark, f"{tmp_path}/b.txt").first()["text"] == "x\ny"


def test_stream_equals_batch(spark, small, tmp_path):
    """Totals and summaries of a stream that stops, restarts and replays equal the batch's."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    parts = pages.randomSplit([1.0, 1.0, 1.0], 7)

    def plan(df):
        return batch.run_batch(df, default_routes()).records.select(
            "page_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
            F.length("title").alias("candidate_count"), (F.col("page_id") % 10 / 10).alias("overall_confidence"))

    schema = plan(pages.limit(0)).schema
    inbox, out, totals = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/totals"

    def intake():
        start_intake(page_stream(spark, inbox, max_files=1), plan, out, f"{tmp_path}/state").awaitTermination()
        start_totals(spark, out, schema, totals, f"{tmp_path}/totals-state", max_files=1).awaitTermination()

    for number, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(inbox)
        if number != 1:  # two files wait for the last start
            intake()
    before = sorted(read_totals(spark, totals).collect())
    for name in os.listdir(f"{tmp_path}/state/commits"):  # as if the driver died before a commit
        if "0" not in name:
            os.rename(f"{tmp_path}/state/commits/{name}", f"{tmp_path}/{name}.gone")
    intake()
    whole = plan(pages)
    assert sorted(read_totals(spark, totals).collect()) == before == sorted(run_totals(whole).collect())
    got = spark.read.parquet(f"{out}/batch=*")
    assert sorted(got.collect(), key=str) == sorted(whole.select(got.columns).collect(), key=str)


def test_batch_counts_while_it_writes(spark, tmp_path):
    rows = [(1, "shop.example.com", "<p>20% off bags today</p>"), (2, "https://b.example.com", " "),
            (3, "https://c.example.com/x", '<html class="navbar"><body>9% off</body></html>'), (4, "ftp://d.example.com", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    urls = pages.select(F.col("page_id").alias("row_number"), F.col("url").alias("requested_url"), "page_id",
                        F.col("url").alias("final_url"))
    fetched = pages.where("page_id < 4")
    summary = batch.summarize_batch(urls, batch.run_batch(fetched, default_routes()))
    assert writers.write_batch_summary(summary, f"{tmp_path}/summary") == {"total": 4, "succeeded": 1, "failed": 3}
    lines = [row for name in glob.glob(f"{tmp_path}/summary/*.csv") for row in csv.DictReader(open(name, encoding="utf-8"))]
    found = {row["row_number"]: row for row in lines}
    assert tuple(lines[0]) == V.SUMMARY_FIELDS
    assert found["1"]["top_offer"] == "20% off bags today" and found["1"]["status"] == "ok"
    assert found["2"]["error"] == f"{V.EMPTY_PAGE_PREFIX}https://b.example.com."
    assert found["3"]["error"] == f"{V.EMPTY_PAGE_PREFIX}https://c.example.com/x."
    assert found["4"]["error"] == V.URL_BAD_SCHEME and found["4"]["candidate_count"] == "0"
