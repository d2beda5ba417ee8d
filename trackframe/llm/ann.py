"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is put into a leaf. A query walks
the tree through a priority queue of nodes, nearest first, which yields all leaves in
the order in which it would visit them. How many it visits is calibrated: for some
queries the true neighbours among all rows are found by brute force, and visits are
widened until the recall that was asked for is reached. Rows and queries then meet
leaf by leaf in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import shuffle_width, stored

BRANCHES = 12
LEAF_ROWS = 256
#: Rows that the tree is fitted on, at most.
SAMPLE = 20_000
#: Queries that visits are calibrated on.
CALIBRATION = 200
#: Leaves are dealt into so many groups at least; a group of many rows goes into
#: blocks, and so do its queries.
GROUPS = 32
BLOCK_ROWS = 5_000
BLOCK_QUERIES = 10_000
#: Rows and queries that are compared at a time.
STEP_ROWS = 500
STEP_QUERIES = 1_000


class Tree:
    """Centres of all nodes, children of each, and the number of each leaf."""

    def __init__(self, sample: np.ndarray, seed: int = 17):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, np.zeros(sample.shape[1]), np.random.default_rng(seed))
        self.centre_rows = np.array(self.centres)

    def _grow(self, rows: np.ndarray, centre: np.ndarray, rng) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        groups = self._split(rows, rng) if len(rows) > LEAF_ROWS else []
        if len(groups) > 1:
            self.children[node] = [self._grow(g, c, rng) for g, c in groups]
        else:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    @staticmethod
    def _split(rows: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
        for _ in range(12):
            near = _distances(rows, centres).argmin(axis=1)
            used = np.unique(near)
            centres = np.array([rows[near == k].mean(axis=0) for k in used])
        near = _distances(rows, centres).argmin(axis=1)
        return [(rows[near == k], centres[k]) for k in range(len(centres)) if (near == k).any()]

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, which = todo.pop()
            kids = self.children[node]
            if not kids:
                out[which] = self.leaf[node]
                continue
            near = _distances(rows[which], self.centre_rows[kids]).argmin(axis=1)
            todo += [(kid, which[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        far = _distances(query[None, :], self.centre_rows)[0]
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (far[kid], kid))


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all of them zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(
        F.forall(vector, finite) & F.exists(vector, lambda x: x != 0.0), F.lit(False)
    )


def _matrix(column) -> np.ndarray:
    """Rows of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same whatever the shape of the blocks."""
    return np.einsum("qd,rd->qr", queries, rows)


FOUND = "query_id long, vec_id long, score double"


def _pairs(query_ids, queries, ids, rows, k: int) -> list[tuple[int, int, float]]:
    out = []
    for at in range(0, len(query_ids), 64):
        scores = _products(queries[at : at + 64], rows)
        for q, row in zip(query_ids[at : at + 64], scores, strict=True):
            other = ids != q
            best = _best(ids[other], row[other], k)
            out += [(int(q), int(i), float(s)) for i, s in
                    zip(ids[other][best], row[other][best], strict=True)]
    return out


def _table(pairs: list[tuple[int, int, float]]) -> dict:
    return {
        "query_id": pa.array([p[0] for p in pairs], pa.int64()),
        "vec_id": pa.array([p[1] for p in pairs], pa.int64()),
        "score": pa.array([p[2] for p in pairs], pa.float64()),
    }


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the limit also holds before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def exact_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries, in one pass over the rows."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = batch.column("vec_id").to_numpy(zero_copy_only=False)
            found = _pairs(ids, queries, here, _matrix(batch.column("embedding")), k)
            yield pa.RecordBatch.from_pydict(_table(found))

    return _ranked(rows.select("vec_id", "embedding").mapInArrow(compare, FOUND), k)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.94,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product.

    ``is_query`` says which rows are queries; a query is no candidate of its own, and
    gets fewer than k rows only if there are fewer. Vectors that are null, zero, not
    finite or not of the most frequent length take no part, nor rows without an id.
    Ties go to the smaller id. Rows that repeat an id and its vector count once; of
    different vectors with one id, each is a candidate and the first is asked. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    found = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
        is_query.alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = found.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n")
    common = sizes.first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    usual = found.filter(F.size("embedding") == common["n"]).dropDuplicates(["vec_id", "embedding"])
    hashed = F.xxhash64("vec_id", F.lit("fit"))
    sample = _matrix(
        usual.orderBy(hashed, "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0)
    )
    tree = Tree(sample)
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def leaf(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.leaves_of(_matrix(column)), pa.int32())

    placed = stored(
        usual.withColumn("leaf", leaf("embedding")).withColumn(
            "asks", F.coalesce("asks", F.lit(False))
        ),
        "leaves",
    )
    counts = np.zeros(tree.leaves, np.int64)
    for row in placed.groupBy("leaf").count().collect():  # leaves are bounded by the sample
        counts[row["leaf"]] = row["count"]
    asked = (
        placed.filter("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )
    turns = max(1, -(-asked.count() // BLOCK_QUERIES))
    trial = asked.orderBy(hashed, "vec_id").limit(CALIBRATION).toArrow()
    if trial.num_rows == 0:
        return empty
    width = _visits_needed(placed, tree, counts, trial, k, recall)
    dealt = _groups(counts)

    @F.arrow_udf("array<struct<at: int, leaves: array<int>>>")
    def route(column: pa.Array) -> pa.Array:
        t, out = shared.value, []
        for query in _matrix(column):
            groups: dict[int, list[int]] = {}
            for x in _route(t, query, counts, width, k):
                groups.setdefault(x % dealt, []).append(x)
            out.append([{"at": g, "leaves": leaves} for g, leaves in groups.items()])
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("leaves", pa.list_(pa.int32()))])))

    # a group of many rows is dealt into blocks, and its queries go to each of them;
    # many queries are dealt into turns, and the rows of a block come to each of them
    totals = [int(counts[g::dealt].sum()) for g in range(dealt)]
    blocks = spark.createDataFrame(
        [(g, max(1, -(-n // BLOCK_ROWS))) for g, n in enumerate(totals)], "at int, blocks int"
    )
    rows = placed.withColumn("at", (F.col("leaf") % dealt).cast("int")).join(
        F.broadcast(blocks), "at"
    ).select(
        "at", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("part"),
        "leaf", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("round"),
    )
    queries = (
        asked.repartition(shuffle_width(spark), "vec_id")
        .select(
            F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"),
            F.pmod(F.xxhash64("vec_id", F.lit("turn")), F.lit(turns)).cast("int").alias("turn"),
            F.explode(route("embedding")).alias("to"),
        )
        .withColumn("group", F.col("to.at"))
        .join(F.broadcast(blocks.withColumnRenamed("at", "group")), "group")
        .select(
            "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            "turn", "query_id", "query", F.col("to.leaves").alias("leaves"),
        )
    )

    def meet(asks: pa.Table, here: pa.Table) -> pa.Table:
        if not asks.num_rows or not here.num_rows:
            return pa.table(_table([]))
        return _best_of_leaves(asks, here, k)

    parts = (
        queries.groupBy("group", "block", "turn").cogroup(rows.groupBy("at", "part", "round"))
        .applyInArrow(meet, FOUND)
    )
    return _ranked(parts, k)


def _groups(counts: np.ndarray) -> int:
    """Groups of leaves: more for a larger table, up to one for each leaf."""
    return max(GROUPS, min(len(counts), -(-int(counts.sum()) // BLOCK_ROWS)))


def _best_of_leaves(asks: pa.Table, here: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query among those of the leaves that it visits."""
    ids, queries = asks.column("query_id").to_numpy(), _matrix(asks.column("query"))
    lists = asks.column("leaves").to_pylist()
    visited = np.concatenate([np.array(x, np.int64) for x in lists])
    visitor = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
    leaf, rows = here.column("leaf").to_numpy(), _matrix(here.column("embedding"))
    row_ids = here.column("vec_id").to_numpy()
    scores = np.full((len(ids), k), -np.inf)
    found = np.full((len(ids), k), np.iinfo(np.int64).max)
    for one in np.unique(leaf):
        everyone, which = visitor[visited == one], np.flatnonzero(leaf == one)
        for first, at in product(
            range(0, len(everyone), STEP_QUERIES), range(0, len(which), STEP_ROWS)
        ):
            who, some = everyone[first : first + STEP_QUERIES], which[at : at + STEP_ROWS]
            new = _products(queries[who], rows[some])
            new[ids[who][:, None] == row_ids[some][None, :]] = -np.inf
            both = np.concatenate([scores[who], new], axis=1)
            names = np.concatenate(
                [found[who], np.broadcast_to(row_ids[some], new.shape)], axis=1
            )
            best = np.lexsort((names, -both), axis=1)[:, :k]
            scores[who] = np.take_along_axis(both, best, axis=1)
            found[who] = np.take_along_axis(names, best, axis=1)
    kept = scores > -np.inf
    return pa.table(
        {
            "query_id": np.repeat(ids, kept.sum(axis=1)), "vec_id": found[kept],
            "score": scores[kept],
        }
    )


def _route(tree: Tree, query: np.ndarray, counts: np.ndarray, width: int, k: int) -> list[int]:
    """The first ``width`` leaves with rows; more while they hold too few candidates."""
    out, seen = [], 0
    for leaf in tree.visits(query):
        if counts[leaf]:
            if len(out) >= width and seen > k:
                break
            out.append(leaf)
            seen += counts[leaf]
    return out


def _visits_needed(placed, tree, counts, trial: pa.Table, k: int, recall: float) -> int:
    """Fewest visits with which the trial queries find the asked share of true neighbours."""
    ids, queries = trial.column("vec_id").to_numpy(), _matrix(trial.column("embedding"))
    truth = exact_neighbours(placed, ids, queries, k)
    leaf_of = placed.select("vec_id", "leaf").groupBy("vec_id").agg(F.min("leaf").alias("leaf"))
    order = {
        int(q): {leaf: n for n, leaf in enumerate(x for x in tree.visits(v) if counts[x])}
        for q, v in zip(ids, queries, strict=True)
    }
    needed = np.sort(
        [order[r["query_id"]][r["leaf"]] + 1 for r in truth.join(leaf_of, "vec_id").collect()]
    )
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
