"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get the same
integer name: the distinct blocks are sorted and numbered. Then adjacent pairs of
names are named in the same way, level by level, until one name is left for each
document. Two documents have the same number of blocks and the same last name
exactly if their bytes are equal; names stand for contents that were compared, not
for hashes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import stored, text_of, unused

BLOCK_BYTES = 4096


def blocks_of(text: Column, size: int) -> Column:
    """The bytes of a text in blocks; an empty text is one empty block."""
    data = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)) - 1, F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size))
    )


def _named(distinct: DataFrame, keys: list[str], keep: list[str], label: str) -> DataFrame:
    """Number distinct rows in sorted order; the numbers are fixed by writing them."""
    return stored(
        distinct.sortWithinPartitions(*keys).select(
            *keep, F.monotonically_increasing_id().alias("name")
        ),
        label,
    )


def _name_blocks(rows: DataFrame, route: Callable[[Column], Column]) -> DataFrame:
    """Rows with ``block`` replaced by its name.

    Blocks are compared where they are numbered. Their names travel back by a hash,
    or by the block itself if two different blocks ever share that hash.
    """
    routed = rows.withColumn("h", route(F.col("block")))
    distinct = routed.select("h", "block").distinct()
    names = _named(distinct, ["h", "block"], ["h"], "block-names")
    clash = names.groupBy("h").count().filter("count > 1").limit(1).count() > 0
    if clash:
        names = _named(distinct, ["h", "block"], ["h", "block"], "block-names")
        return routed.join(names, ["h", "block"]).drop("h", "block")
    return routed.drop("block").join(names, "h").drop("h")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the largest id stays; a null id is the smallest.
    Null texts equal empty ones. Rows that repeat id and text count one by one, and
    one of them stays. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    parts = rows.select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        blocks_of(F.col("text"), block_bytes).alias("blocks"),
    ).select(
        "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")
    )
    # rows that repeat an id and its text become one row with a count
    named = stored(
        _name_blocks(parts, route)
        .groupBy("doc_id", "sha", "n", "pos")
        .agg(F.max("name").alias("name"), F.count("*").alias("copies")),
        "block-level",
    )
    current = named.withColumn("left", F.col("n"))
    done = current.filter("left = 1")
    most = named.agg(F.max("n")).first()[0] or 1
    while most > 1:
        pairs = (
            current.filter("left > 1")
            .groupBy("doc_id", "sha", "n", "copies", "left", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias(
                    "b"
                ),
            )
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "pair-names")
        current = stored(
            pairs.join(names, ["a", "b"]).select(
                "doc_id", "sha", "n", "copies", "pos", "name",
                F.ceil(F.col("left") / 2).cast("int").alias("left"),
            ),
            "pair-level",
        )
        done = done.unionByName(current.filter("left = 1"))
        most = (most + 1) // 2
    # written, so that the join can split a group of very many documents
    groups = stored(
        done.groupBy("n", "name").agg(
            F.sum("copies").alias("group_size"), F.max("doc_id").alias("keep_id")
        ),
        "groups",
    )
    return (
        done.join(groups, ["n", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            F.col("doc_id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows that stay, with all their columns."""
    sha, of_id, of_sha = (unused(docs, n) for n in ("sha_", "of_id_", "of_sha_"))
    kept = (
        exact_duplicates(docs, id_col, text_col, **options)
        .filter("kept")
        .select(F.col(id_col).alias(of_id), F.col("text_sha256").alias(of_sha))
    )
    tagged = docs.withColumn(sha, F.sha2(text_of(text_col), 256))
    joined = tagged.join(
        kept, (F.col(sha) == F.col(of_sha)) & tagged[id_col].eqNullSafe(kept[of_id])
    )
    return joined.dropDuplicates([sha, id_col]).select(*[docs[c] for c in docs.columns])
