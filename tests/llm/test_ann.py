import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trackframe.llm import ann
from trackframe.llm.ann import nearest_neighbours
from trackframe.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, score string, leaf string, rank string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "s", "l", "r", 1) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([np.array(v, np.float32) for _, v in rows], float)
    out = {}
    for q in queries:
        scores = matrix @ matrix[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), round(float(scores[i]), 9)) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_measure_on_the_table(spark):
    vectors = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = found(nearest_neighbours(vectors, F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_few_rows_ties_and_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 5.0]), (20, [0.0, 1.0])]
    odd = [(4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
           (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (40, []), (None, [1.0, 1.0]), (1, [2.0, 0.0])]
    got = found(nearest_neighbours(table(spark, rows + odd), F.col("vec_id") % 20 == 0))
    assert got == brute(rows, [0, 20], 20)
    assert [i for i, _ in got[0]][:2] == [1, 2]


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.6, 0.8]) for i in range(3000)]
    turns = rng.random(500) * 6.28
    rows += [(3000 + i, [float(0.5 * np.cos(t)), float(0.5 * np.sin(t))]) for i, t in enumerate(turns.tolist())]
    queries = [0, 20, 3000, 3020]
    got = found(nearest_neighbours(table(spark, rows), F.col("vec_id").isin(queries), recall=1.0))
    want = brute(rows, queries, 20)
    assert [i for i, _ in got[20]] == [i for i, _ in want[20]] == list(range(20))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    assert hits >= 0.9 * 80


def test_no_rows_and_no_queries(spark):
    assert nearest_neighbours(table(spark, []), F.lit(True)).count() == 0
    assert nearest_neighbours(table(spark, [(1, [1.0])]), F.lit(False)).count() == 0
    assert nearest_neighbours(table(spark, [(1, [1.0])]), F.lit(True)).count() == 0


def test_memory_does_not_grow_with_the_queries_of_a_leaf():
    rng = np.random.default_rng(5)
    n, dim = 12_000, 4
    vectors = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    queries, rows = rng.normal(size=(n, dim)), rng.normal(size=(600, dim))
    asks = pa.table({"query_id": np.arange(n), "query": vectors(queries), "leaves": [[0]] * n})
    here = pa.table({"leaf": np.zeros(600, int), "vec_id": np.arange(600) + n, "embedding": vectors(rows)})
    tracemalloc.start()
    got = ann._best_of_leaves(asks, here, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # products of all queries with 500 rows have 48 MB, and are needed four times
    want = np.argsort(-(queries @ rows.T), axis=1)[:, :3] + n
    assert (got.column("vec_id").to_numpy().reshape(n, 3) == want).all()


def test_queries_rows_and_groups_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 4)).astype(np.float32).tolist())]
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    df = nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, k=5, recall=1.0)
    assert found(df) == brute(rows, [i for i, _ in rows if i % 20 == 0], 5)


def test_groups_grow_with_the_table():
    assert ann._groups(np.full(200, 100)) == ann.GROUPS
    assert ann._groups(np.full(200, 2000)) == 80
    assert ann._groups(np.full(200, 2_000_000)) == 200
