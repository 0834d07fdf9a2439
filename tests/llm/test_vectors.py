"""Vector operators against brute force, and their edge cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlode.llm import ann, queries, vector_dedup
from offerlode.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int, raw string"
ODD = [
    (1, None, 0, "x"), (2, [0.0, 0.0, 0.0], 0, "x"), (3, [1.0, None, 0.0], 0, "x"), (4, [1.0, float("nan"), 0.0], 0, "x"),
    (5, [float("inf"), 0.0, 0.0], 0, "x"), (6, [], 0, "x"), (None, [1.0, 2.0, 3.0], 0, "x"), (8, [1.0, 2.0, 3.0], 0, "x"),
    (9, [1.0, 2.0, 3.0], 0, "x"), (9, [1.0, 2.0, 3.0], 0, "x"), (10, [2.0, 4.0, 6.0], 0, "x"), (11, [1.0, 2.0], 0, "x"),
    (20, [-1.0, 0.5, 0.0], 0, "x"), (40, [1e30, 2e30, 3e30], 0, "x"),
]


@pytest.fixture
def vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)


def test_links_equal_brute_force(spark, vectors):
    ids, values = vectors
    rng = np.random.default_rng(0)
    values[100:160] = values[rng.integers(0, 40, 60)] + 0.035 * rng.standard_normal((60, values.shape[1]))
    values = values.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in zip(ids, values)], VECTORS)
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in vector_dedup.linked_vectors(frame).collect()}
    assert len(got) == len(ids) and linked.any()
    assert [got[i].n_links for i in ids] == linked.sum(1).tolist()
    root = list(range(len(ids)))
    for _ in ids:
        root = [min([root[j] for j in np.flatnonzero(linked[i])] + [root[i]]) for i in range(len(ids))]
    assert [got[i].component_id for i in ids] == [ids[r] for r in root]
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_hot_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", 8)
    rng = np.random.default_rng(1)
    values = rng.standard_normal(16) + 0.03 * rng.standard_normal((100, 16))
    values = np.concatenate([values, rng.standard_normal((40, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(values)]
    unit = values.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    got = {r.vec_id: r for r in vector_dedup.linked_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert [got[i].n_links for i in range(140)] == (linked.sum(1) - 1).tolist()
    assert {got[i].component_id for i in range(100)} == {0}


def test_links_of_odd_vectors(spark):
    frame = spark.createDataFrame(ODD, VECTORS)
    rows = vector_dedup.linked_vectors(frame).collect()
    assert len(rows) == len(ODD)
    got = collections.defaultdict(set)
    for row in rows:
        got[row.vec_id].add((row.n_links, row.component_id, row.kept))
    for alone in (1, 2, 3, 4, 5, 6, 11, 20):
        assert got[alone] == {(0, alone, True)}
    assert got[None] == {(0, None, True)}
    assert got[8] == {(4, 8, True)} and got[9] == got[10] == got[40] == {(4, 8, False)}
    assert vector_dedup.linked_vectors(frame.limit(0)).count() == 0


def test_table_plan_reaches_its_recall():
    for rows in (10, 1000, 10**6, 10**9):
        bits, tables = vector_dedup.plan_tables(rows)
        meets = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - meets) ** tables >= 0.999


def test_nearest_equal_brute_force(spark, small, vectors):
    ids, values = vectors
    scores = values @ values.T
    got = collections.defaultdict(list)
    for row in queries.op8_ann(spark, small).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    hits = total = 0
    for at, query in enumerate(ids):
        if query % 20:
            continue
        order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-scores[at, j], ids[j]))[:20]
        assert [rank for rank, _, _ in got[query]] == list(range(1, len(order) + 1))
        assert all(score == pytest.approx(scores[at, ids.index(v)], abs=1e-12) for _, v, score in got[query])
        hits += len({v for _, v, _ in got[query]} & {ids[j] for j in order})
        total += len(order)
    assert set(got) == {i for i in ids if i % 20 == 0} and hits / total > 0.97


def test_blocks_join_up(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    rng = np.random.default_rng(2)
    values = rng.standard_normal((300, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(values)], VECTORS)
    got = collections.defaultdict(set)
    for row in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got[row.query_id].add(row.vec_id)
    scores = values.astype(float) @ values.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(got[q] & set(np.argsort(-scores[q])[:20].tolist())) for q in range(0, 300, 20))
    assert hits / (15 * 20) > 0.97 and all(len(found) == 20 for found in got.values())


def test_bounds_hold():
    rng = np.random.default_rng(3)
    values, queries_ = rng.standard_normal((2000, 48)), rng.standard_normal((20, 48))
    codec = ann.Codec(values.mean(0))
    estimate, error = codec.bounds(queries_, *codec.encode(values))
    away = np.abs(estimate - queries_ @ values.T)
    assert (away <= error).mean() > 0.93 and np.abs((estimate - queries_ @ values.T).mean()) < 0.05


def test_nearest_of_odd_vectors(spark):
    frame = spark.createDataFrame(ODD, VECTORS)
    got = collections.defaultdict(list)
    for row in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[row.query_id].append(row.vec_id)
    assert set(got) == {20, 40}
    assert got[40] == [10, 8, 9, 20] and got[20][-1] == 40
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("task_edges", [200_000, 40])
def test_components_of_chains_and_stars(spark, monkeypatch, task_edges):
    monkeypatch.setattr("offerlode.llm.components.FOREST_EDGES", task_edges)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = [*chain, *star, (5000, 5000), (7, 3), (None, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_nearest_of_mixed_lengths_and_huge_vectors(spark):
    rng = np.random.default_rng(4)
    short, long = rng.standard_normal((90, 8)), rng.standard_normal((60, 12))
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate([*short, *long])]
    rows[7] = (7, (short[7] * 1e200).tolist(), 0, "")
    frame = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    values = {row[0]: np.array(row[1]) for row in rows}
    got = collections.defaultdict(list)
    for row in ann.nearest(frame, F.col("vec_id") % 20 == 0, 5).orderBy("rank").collect():
        got[row.query_id].append(row.vec_id)
    assert set(got) == set(range(0, 150, 20))
    hits = 0
    for query, found in got.items():
        near = [i for i in values if i != query and len(values[i]) == len(values[query])]
        near = sorted(near, key=lambda i: (-(values[i] * values[query]).sum(), i))[:5]
        assert len(found) == 5 and (7 in near) == (7 in found)
        hits += len(set(near) & set(found))
    assert hits >= 0.95 * 5 * len(got)
