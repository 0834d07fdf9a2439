"""Each stage of the pipeline on its own input."""

import corpus_pipeline
import pytest

from offerlode.llm import bpe, simhash
from offerlode.llm.common import durable, table


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs, made = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, docs, folder), name)
        made.append((name, docs, out))
        docs = out
    return made


def test_stages_return_the_columns_of_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    toxic = [i for i, t in labels.items() if t]
    clean = [i for i, t in labels.items() if not t]
    # Forty toxic documents teach few stems; on the large tables all held-out ones go.
    assert sum(i in kept for i in toxic) <= 0.4 * len(toxic)
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_lines_and_copies_go(stages):
    (_, _, filtered), (_, _, lines), (_, _, unique), (_, _, mixed), (_, _, encoded) = stages
    assert lines.count() == filtered.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    texts = [r.text for r in unique.collect()]
    assert len(texts) == len(set(texts)) < lines.count()
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in unique.collect()}
    assert encoded.count() == mixed.count()
    assert sorted(map(tuple, encoded.collect())) == sorted(map(tuple, bpe.token_digests(mixed).collect()))


def test_near_copy_stage_sends_no_cells_to_the_driver(spark, stages, monkeypatch):
    plans, found = [], simhash.components

    def watched(edges, *ends):
        edges.collect()
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return found(edges, *ends)

    monkeypatch.setattr(simhash, "components", watched)
    corpus_pipeline.drop_near_copies(spark, stages[1][2].limit(20), "")
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[-1][2].collect()))
