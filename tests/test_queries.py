"""Every registered query has SQL; a few run against it here, all in ``compare.py``."""

import pytest
from compare import compare, database

from offerlode.queries.registry import ORACLES, QUERIES

SAMPLE = ("src_url_list", "url_normalize", "url_output_stem", "coupon_code_valid",
          "store_from_html", "html_clean_nodes", "rank_filter", "run_metrics")


def test_every_query_is_checked_by_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, small, name):
    equal, rows, _, sample = compare(spark, con, small, name, QUERIES[name], ORACLES[name])
    assert rows > 0 and equal, sample
