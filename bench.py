"""Time the headline queries, each on its own, and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from offerlode.queries.registry import QUERIES  # noqa: E402
from offerlode.session import build_session, sharing  # noqa: E402
from offerlode.sources.tables import table  # noqa: E402

#: Query and the table whose rows it works through, for rows a second.
HEADLINE = {
    "line_split": "lineitem", "sig_percent": "lineitem", "score": "lineitem",
    "dedup_canonical": "lineitem", "rank_filter": "lineitem", "page_confidence": "lineitem",
    "run_metrics": "lineitem", "render_text": "lineitem", "html_to_text": "pages",
    "extract_generic": "pages", "extract_site": "pages", "batch_summary": "pages",
    "url_output_stem": "pages",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "offerlode-bench")
    rows = {name: table(spark, folder, name).count() for name in set(HEADLINE.values())}
    # Untimed: the first queries also start the JVM's compiler and the Python workers.
    for name in ("line_split", "html_to_text"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds, rates = {}, {}
    for name, source in HEADLINE.items():
        spark.catalog.clearCache()  # no query reads what another one kept
        with sharing():
            started = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - started, 3)
        unit = "lines_per_sec" if source == "lineitem" else "pages_per_sec"
        rates.setdefault(unit, {})[name] = round(rows[source] / max(seconds[name], 1e-3))
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), **rates,
    }))


if __name__ == "__main__":
    main()
