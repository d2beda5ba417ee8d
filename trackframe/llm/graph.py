"""Connected components of edge tables, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to its smallest one.

    The large star moves greater neighbours, the small star smaller ones and the node
    itself. Minima are aggregates, written down so that the join back can split a
    node of very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(stored(least, "star"), "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "star")
        moved = (
            down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
        )
    return moved.filter("a != b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every a has one b, and no b is an a itself: then b is the label of a."""
    row = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("ends")).first()
    if row["n"] != row["ends"]:
        return False
    centres = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(centres, "a", "left_semi").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge; the label is the least node reached.

    ``edges`` has long columns a and b. The number of rounds grows with the logarithm
    of the nodes, whatever the length of chains. No edges give no rows.
    """
    current = stored(edges.select("a", "b").filter("a != b").distinct(), "edges")
    settled = False
    while not settled:
        current = stored(_star(stored(_star(current, True), "edges"), False), "edges")
        settled = _is_forest_of_stars(current)
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
