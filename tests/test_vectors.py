"""Neighbour search against brute force, and the blended classifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaydesk.operators import neighbours as nb


def table(spark, matrix, labels=None):
    rows = [(i, [float(x) for x in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int")


def brute(q, b, k, skip_self):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m),
                               where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = np.round(unit(q) @ unit(b).T, 9)
    out = {}
    for i, row in enumerate(sims):
        order = sorted((j for j in range(len(b)) if not (skip_self and i == j)), key=lambda j: (-row[j], j))
        out[i] = order[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    # one cluster holds most points, with exact copies and zero vectors among them
    which = np.r_[np.zeros(250, int), rng.integers(0, 5, 150)]
    m = centres[which] + 0.3 * rng.normal(size=(400, 8))
    m[10:20] = m[5]
    m[20:23] = 0.0
    return m, which


@pytest.mark.parametrize("skip_self", [True, False])
@pytest.mark.parametrize("search", ["plain", "pruned"])
def test_exact(spark, points, search, skip_self):
    m, _ = points
    base = table(spark, m)
    queries = base.withColumnRenamed("id", "query_id")
    if search == "plain":
        got = nb.nearest(queries, base, 4, exclude_self=skip_self)
    else:
        got = nb.nearest_pruned(queries, base, 4, exclude_self=skip_self, pivots=6, block_rows=50)
    assert found(got) == brute(m, m, 4, skip_self)


def test_more_neighbours_than_rows(spark):
    m = np.eye(3)
    base = table(spark, m)
    got = found(nb.nearest(base.withColumnRenamed("id", "query_id"), base, 10, exclude_self=True))
    assert {q: len(v) for q, v in got.items()} == {0: 2, 1: 2, 2: 2}
    got = found(nb.nearest_pruned(base.withColumnRenamed("id", "query_id"), base, 10, pivots=2, block_rows=2))
    assert {q: len(v) for q, v in got.items()} == {0: 3, 1: 3, 2: 3}


def test_string_ids(spark, points):
    m, _ = points
    base = table(spark, m[:60]).withColumn("id", F.format_string("r%03d", "id"))
    queries = base.withColumnRenamed("id", "query_id")
    want = {f"r{q:03d}": [f"r{i:03d}" for i in v] for q, v in brute(m[:60], m[:60], 3, True).items()}
    assert found(nb.nearest(queries, base, 3, exclude_self=True)) == want
    assert found(nb.nearest_pruned(queries, base, 3, exclude_self=True, pivots=4, block_rows=10)) == want


def test_one_query(spark, points):
    m, _ = points
    got = [r["id"] for r in nb.one_query_top_k(table(spark, m), list(m[0]), 5).collect()]
    assert got == brute(m[:1], m, 5, False)[0]


def test_blend(spark, points):
    m, which = points
    base = table(spark, m, which)
    out = {r["query_id"]: r for r in nb.classify_blend(base.select(F.col("id").alias("query_id"), "vec"), base).collect()}
    assert len(out) == len(m)
    near = brute(m, m, 5, True)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cents = np.array([m[which == c].mean(axis=0) for c in range(5)])
    cents /= np.linalg.norm(cents, axis=1, keepdims=True)
    for i in (0, 7, 300, 399):
        votes = np.zeros(5)
        for j in near[i]:
            votes[which[j]] += round(float(unit[i] @ unit[j]), 9)
        score = 0.6 * votes / votes.max() + 0.4 * cents @ unit[i]
        score /= score.sum()
        assert out[i]["intent"] == int(score.argmax())
        assert out[i]["intent_confidence"] == pytest.approx(score.max(), abs=1e-4)
        assert sum(out[i]["intent_all_scores"].values()) == pytest.approx(1.0, abs=1e-3)
    # a zero vector has no positive vote and still gets an answer
    assert out[20]["intent"] is not None


def test_retrieve(spark):
    kb = spark.createDataFrame([("a", "q1", "r1", [1.0, 0.0]), ("b", "q2", "r2", [1.0, 1.0]), ("c", "q3", "r3", [0.0, 1.0])],
                               "id string, customer_query string, support_response string, vec array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.1])], "query_id string, vec array<double>")
    cases = nb.retrieve_cases(q, kb, 3, exclude_self=False).first()["retrieved_cases"]
    assert [c["id"] for c in cases] == ["a", "b", "c"] and cases[0]["similarity"] == 0.995
    cases = nb.retrieve_cases(q, kb, 3).first()["retrieved_cases"]
    assert [c["id"] for c in cases] == ["b", "c"]


def test_a_query_is_sent_to_few_blocks(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(2000, 16))  # cells that all can hold a neighbour of any query
    base, sent, search = table(spark, m), [], nb._search_blocks

    def counted(routed, *more):
        sent.append(routed.count())
        return search(routed, *more)

    monkeypatch.setattr(nb, "_search_blocks", counted)
    got = nb.nearest_pruned(base.withColumnRenamed("id", "query_id"), base, 3, pivots=4, block_rows=10)
    assert found(got) == brute(m, m, 3, False)
    assert sum(sent) <= len(m) * (4 + spark.sparkContext.defaultParallelism)


def test_unit_rows_take_one_matrix():
    import tracemalloc

    import pandas as pd

    m = np.random.default_rng(2).normal(size=(16_384, 256))
    m[7] = 0.0
    col = pd.Series(list(m.copy()))
    tracemalloc.start()
    got = nb._unit_rows(col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    assert np.array_equal(got, np.divide(m, n, out=np.zeros_like(m), where=n > 0))
    assert peak < 1.5 * m.nbytes


@pytest.mark.parametrize("skip_self", [True, False])
def test_packed_blocks(spark, points, monkeypatch, skip_self):
    """Many blocks, with ties between them: vectors are dealt once to a side, a pair of blocks meets without a shuffle."""
    monkeypatch.setattr(nb, "PACK_ROWS", 16)
    m, _ = points
    base = table(spark, m)
    got = nb.nearest(base.withColumnRenamed("id", "query_id"), base, 4, exclude_self=skip_self)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan and "vecs" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
    assert found(got) == brute(m, m, 4, skip_self)


@pytest.mark.parametrize("tile, piece", [(256, 8192), (7, 3)])
def test_blocks_one_after_the_other(monkeypatch, tile, piece):
    import pyarrow as pa

    monkeypatch.setattr(nb, "TILE_QUERIES", tile)
    monkeypatch.setattr(nb, "PIECE_PAIRS", piece)
    rng = np.random.default_rng(3)
    b = nb._to_unit(rng.normal(size=(300, 12)))
    b[250:260], b[200] = b[3], 0.0
    b[40:60] = nb._to_unit(b[40] + 1e-8 * rng.normal(size=(20, 12)))  # alike in single precision
    q = np.concatenate([b[:50], nb._to_unit(rng.normal(size=(30, 12)))])
    chunk = nb._Chunk(pa.array(np.arange(80)), q, 4)
    for lo in (100, 0, 200):  # blocks in any order
        chunk.meet(pa.array(np.arange(lo, lo + 100)), b[lo:lo + 100])
    hits = [x for part in chunk.found() for x in zip(*(np.asarray(y).tolist() for y in part))]
    best = {}
    for i, j, value in sorted(hits, key=lambda x: (x[0], -x[2], x[1])):
        best.setdefault(i, []).append(j)
    assert {i: x[:4] for i, x in best.items()} == brute(q, b, 4, False)
    assert len(hits) < 80 * 3 * 4 / 2


def test_one_row_of_a_repeated_id_is_left_out(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])]
    base = spark.createDataFrame(rows, "id long, vec array<double>")
    got = nb.nearest(base.where("id = 1").limit(1).withColumnRenamed("id", "query_id"), base, 5, exclude_self=True)
    assert [(r.id, round(r.similarity, 6)) for r in got.orderBy("rank").collect()] == [(1, 1.0), (None, 0.707107), (2, 0.0)]


def test_a_base_is_packed_once(spark, work, points):
    m, _ = points
    base, search = table(spark, m), nb.PackedSearch(work)
    staged, stage = [], type(work).stage
    work.__dict__["stage"] = lambda name, *more: (staged.append(name), stage(work, name, *more))[1]
    for part in (base.where("id < 9"), base.where("id between 9 and 20")):
        q = part.withColumnRenamed("id", "query_id")
        both = [found(search(q, base, k, exclude_self=True)) for k in (3, 2)]
        want = brute(m, m, 3, True)
        assert both[0] == {i: want[i] for i in both[0]} and both[1] == {i: x[:2] for i, x in both[0].items()} and len(both[0]) in (9, 12)
    assert staged == ["base-0", "queries", "queries"]
