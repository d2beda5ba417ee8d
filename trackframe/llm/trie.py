"""Prefix trie of conversations by fixed-length block hashing.

Every turn is a digest, and a conversation is cut into blocks of a fixed number of
turns. A block is named by the digest of its turns and of the path before it, so
conversations with the same name share everything up to there, and are counted
together from then on: one row per distinct block, however many conversations hold
it. Turn by turn, a block is only looked into further where its parent has several
blocks: they may share some of their first turns. An only block shares its turns with
nobody, so each of its turns is a node as it stands.

What a subtree saves needs no walk down the tree. Each node is owned by its smallest
member, and what a conversation owns is a tail of its path; so a conversation spares
the bytes before that tail, and sums over the members of a node give the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import shuffle_width, stored, text_of

#: Turns of a block.
BLOCK_TURNS = 8
#: Bytes of a digest.
WIDTH = 32
#: Ids that are joined to one text before their node takes them up.
IDS = 65_536

#: The name of the path without turns.
ROOT = b""


def digest(role: Column, text: Column) -> Column:
    """One value per (role, text); the length keeps their border."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.sha2(whole, 256))


def turns_of(convs: DataFrame) -> DataFrame:
    """(conv_id, rn, digest, size) of conversations in order of their turns, from 1.

    A null turn comes first; turns that tie are ordered by digest. Rows without a
    conversation id belong to none.
    """
    rows = convs.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        digest(text_of("role"), text_of("text")).alias("digest"),
        F.octet_length(text_of("text")).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("rn"), "digest", "size")


def with_shared_starts(turns: DataFrame, every: int = 5, starts: int = 9) -> DataFrame:
    """Conversations that start as the first of their ``every`` ids does.

    Of conversation c the first h turns are those of c - c % every, h being the crc32
    of its id modulo ``starts``; its own follow after its first h. A row of position 0
    stands for each conversation, also for one without turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % starts).cast("int")
    ids = turns.filter("rn = 1").select("conv_id")
    first = turns.filter((F.col("rn") < starts) & (F.col("conv_id") % every == 0))
    shared = (
        first.withColumnRenamed("conv_id", "base")
        .join(ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every), "base")
        .filter(F.col("rn") <= h)
        .select("conv_id", "rn", "digest", "size")
    )
    none = ids.select(
        "conv_id", F.lit(0).alias("rn"), F.lit(None).cast("binary").alias("digest"),
        F.lit(0).cast("long").alias("size"),
    )
    return turns.filter(F.col("rn") > h).unionByName(shared).unionByName(none)


BLOCKS = (
    "conv_id long, k int, parent binary, digests binary, sizes array<long>, before long, last boolean"
)


def _blocks(
    batches: Iterator[pa.RecordBatch], most: int = BLOCK_TURNS
) -> Iterator[pa.RecordBatch]:
    """Turns in order -> blocks; one block and the name of the path before are held."""
    conv, k, parent, digests, sizes, before = None, 0, ROOT, [], [], 0
    out: list[tuple] = []

    def close(last: bool) -> None:
        out.append((conv, k, parent, b"".join(digests), sizes, before, last))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()),
                 pa.int64(), pa.bool_()]
        names = ["conv_id", "k", "parent", "digests", "sizes", "before", "last"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_id", "rn", "digest", "size"))
        for own, position, turn, size in zip(*columns, strict=True):
            if position == 0:
                if conv is not None:
                    close(True)
                conv, k, parent, digests, sizes, before = own, 0, ROOT, [], [], 0
                continue
            if len(digests) == most:
                close(False)
                parent = hashlib.sha256(parent + b"".join(digests)).digest()
                k, before, digests, sizes = k + 1, before + sum(sizes), [], []
            digests.append(turn)
            sizes.append(size)
        if out:
            yield batch_of(out)
            out = []
    if conv is not None:
        close(True)
        yield batch_of(out)


def _name(parent: Column, digests: Column) -> Column:
    return F.unhex(F.sha2(F.concat(parent, digests), 256))


def blocks_of(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The blocks of each conversation; ``key`` names a block with all before it."""
    width = shuffle_width(turns.sparkSession)
    ordered = turns.repartition(width, "conv_id").sortWithinPartitions("conv_id", "rn")
    return ordered.mapInArrow(partial(_blocks, most=block_turns), BLOCKS).withColumn(
        "key",
        F.when(F.octet_length("digests") == 0, F.lit(ROOT)).otherwise(
            _name(F.col("parent"), F.col("digests"))
        ),
    )


def _distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row per distinct block, with what its conversations come to.

    ``single``: its parent has no other.
    """
    distinct = stored(
        blocks.filter(F.octet_length("digests") > 0)
        .groupBy("key", "parent", "k")
        .agg(
            F.max("digests").alias("digests"),
            F.max("sizes").alias("sizes"),
            F.max("before").alias("before"),
            F.count("*").alias("n"),
            F.sum(F.col("last").cast("long")).alias("ends"),
            F.min("conv_id").alias("conv_id"),
        ),
        "trie-blocks",
    )
    only = (
        distinct.groupBy("parent").agg(F.count("*").alias("c"), F.min("key").alias("key"))
        .filter("c = 1").select("key", F.lit(True).alias("single"))
    )
    return distinct.join(only, "key", "left").fillna(False, ["single"])


def _nodes(distinct: DataFrame, sums: list[str], block_turns: int) -> DataFrame:
    """A row per turn of a block, those of blocks that share a beginning put together.

    Columns: key, parent, depth, before (bytes ahead of the last turn), n, ends, conv_id
    (the smallest), and for ``sums`` their sums; ``u_rep`` belongs to the smallest.
    """
    j, size = F.col("j"), (F.octet_length("digests") / WIDTH).cast("int")
    start = lambda n: F.substring(F.col("digests"), F.lit(1), n * WIDTH)
    rep = F.struct("conv_id", *(["u_rep"] if sums else []))
    each = distinct.withColumn("j", F.explode(F.sequence(F.lit(1), size))).select(
        F.when(j == size, F.col("key")).otherwise(_name(F.col("parent"), start(j))).alias("key"),
        F.when(j == 1, F.col("parent"))
        .otherwise(_name(F.col("parent"), start(j - 1)))
        .alias("parent"),
        (F.col("k") * block_turns + j).cast("long").alias("depth"),
        (
            F.col("before")
            + F.aggregate(F.slice("sizes", F.lit(1), j - 1), F.lit(0).cast("long"), lambda a, b: a + b)
        ).alias("before"),
        "n", F.when(j == size, F.col("ends")).otherwise(0).alias("ends"),
        rep.alias("rep"), "single", *sums,
    )
    plain = ["key", "parent", "depth", "before", "n", "ends", "rep", *sums]
    merged = (
        each.filter(~F.col("single")).groupBy("key", "parent", "depth")
        .agg(
            F.max("before").alias("before"), F.sum("n").alias("n"), F.sum("ends").alias("ends"),
            F.min("rep").alias("rep"), *[F.sum(c).alias(c) for c in sums],
        )
    )
    found = each.filter("single").select(*plain).unionByName(merged.select(*plain))
    return found.select("*", "rep.*").drop("rep")


def _root(blocks: DataFrame, *more: Column) -> DataFrame:
    """The node without turns that all conversations start at; none if there are none."""
    zero = F.lit(0).cast("long")
    last = blocks.filter("last").agg(
        F.count("*").alias("n"), F.sum((F.octet_length("digests") == 0).cast("long")).alias("ends"),
        F.min("conv_id").alias("conv_id"), *more,
    ).filter("n > 0")
    return last.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"),
        zero.alias("before"), "*",
    )


def _shares(blocks: DataFrame, distinct: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, u, leaves) of every conversation.

    ``u``: bytes of its turns up to the first node it owns. ``leaves``: 1 if it owns a
    node without children.
    """
    plain = ["key", "parent", "depth", "before", "n", "ends", "conv_id"]
    nodes = _nodes(distinct, [], block_turns).select(*plain).unionByName(_root(blocks).select(*plain))
    owners = nodes.groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("owned_from"),
        F.max((F.col("n") == F.col("ends")).cast("long")).alias("leaves"),
    )
    total = F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    return (
        blocks.filter("last").select("conv_id", total.alias("total"))
        .join(owners, "conv_id", "left")
        .select(
            "conv_id", F.coalesce("owned_from", "total").alias("u"),
            F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"),
        )
    )


def _join_ids(batches: Iterator[pa.RecordBatch], most: int = IDS) -> Iterator[pa.RecordBatch]:
    """Ordered (key, conv_id) -> (key, first, ids): ids of a node in bounded texts."""
    key, ids = None, []
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys, firsts, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())],
            ["key", "first", "ids"],
        )

    for batch in batches:
        for own, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (own != key or len(ids) == most):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = own
            ids.append(conv)
        if out:
            yield batch_of(out)
            out = []
    if ids:
        yield batch_of([(key, ids[0], ",".join(map(str, ids)))])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (key, first, ids) -> (key, sha); one text is held at a time."""
    key, state = None, None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys, found = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "sha"]
        )

    for batch in batches:
        for own, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if state is not None and own == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield batch_of(out)
            out = []
    if state is not None:
        yield batch_of([(key, state.hexdigest())])


def _ends(blocks: DataFrame, ids_per_text: int) -> DataFrame:
    """(key, sha) of the nodes where conversations end."""
    width = shuffle_width(blocks.sparkSession)
    texts = (
        blocks.filter("last").select("key", "conv_id")
        .repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInArrow(partial(_join_ids, most=ids_per_text), "key binary, first long, ids string")
    )
    return (
        texts.repartition(width, "key").sortWithinPartitions("key", "first")
        .mapInArrow(_hash_ids, "key binary, sha string")
    )


def prefix_trie(
    turns: DataFrame, block_turns: int = BLOCK_TURNS, ids_per_text: int = IDS
) -> DataFrame:
    """A row per distinct sequence of first turns: the nodes of the trie.

    ``turns``: (conv_id, rn, digest, size), with a row of position 0 for each
    conversation, as :func:`with_shared_starts` gives. Columns: conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (bytes that one copy per node spares in the subtree), ends_sha256 (of the ids that end
    there), key and parent_key. Without conversations there are no nodes. Digests of one
    conversation pass through a task one block at a time, so its length is not bounded.
    """
    blocks = stored(blocks_of(turns, block_turns), "trie-rows")
    distinct = stored(_distinct_blocks(blocks), "trie-distinct")
    weighed = stored(blocks.join(_shares(blocks, distinct, block_turns), "conv_id"), "trie-weighed")
    sums = ["u", "leaves"]
    per_block = weighed.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in sums], F.min_by("u", "conv_id").alias("u_rep")
    )
    whole = [F.sum(c).alias(c) for c in sums] + [F.min_by("u", "conv_id").alias("u_rep")]
    nodes = stored(
        _nodes(distinct.join(per_block, "key"), sums, block_turns).unionByName(_root(weighed, *whole)),
        "trie-nodes",
    )
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # written, so that the join can split the children of a large node
    placed = stored(nodes.join(parents, "parent", "left"), "trie-placed")
    children = (
        nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key"))
        .agg(F.count("*").alias("n_children"))
    )
    return (
        placed.join(children, "key", "left").join(_ends(blocks, ids_per_text), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("u") - F.col("u_rep") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
            F.col("key"), F.col("parent").alias("parent_key"),
        )
    )
