"""Byte-level BPE over a public rank file, in overlapping chunks.

A text is pre-tokenised chunk by chunk. Neighbouring chunks overlap; the first
boundary of pre-tokens that both see there is where the second takes over, because
from a common boundary on both cut the text alike. Pieces between those places
are encoded on their own. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import text_of

_LOADED: dict = {}


class Ranks:
    """A vocabulary with its split pattern; loaded once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merges = tiktoken.Encoding(
            "public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        """Ids of a stretch that begins and ends at boundaries, pre-token by pre-token."""
        return self.merges.encode_ordinary(text)

    def boundaries(self, text: str) -> list[int]:
        """Offsets where pre-tokens start."""
        return [m.start() for m in self.split.finditer(text)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def ranks_at(path: str, pattern: str) -> Ranks:
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Ranks(path, pattern)
    return _LOADED[key]


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of texts that are short enough for one chunk."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ranks = ranks_at(path, pattern)
        flat, ends = array("i"), array("i", [0])
        for text in texts:
            flat.extend(ranks.encode(text.as_py()))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(
            pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32))
        )

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        ranks = ranks_at(path, pattern)
        flat = lists.values.to_numpy()
        ends = lists.offsets.to_numpy()
        return pa.array(
            [ranks.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)],
            pa.binary(),
        )

    return decode(ids)


def _chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    last = F.floor((F.length("text") - 1) / size).cast("int")
    return (
        docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("window", F.substring("text", F.col("chunk") * size + 1, F.lit(size + overlap)))
        .withColumn("last", F.col("chunk") == last)
        .select("doc_id", "sha", "copies", "chunk", "last", "window")
    )


def _encode_long(
    docs: DataFrame, path: str, pattern: str, size: int, overlap: int
) -> DataFrame:
    """Documents of several chunks, (doc_id, ids); each chunk is a row of its own."""

    @F.arrow_udf("head array<int>, tail array<int>")
    def borders(windows: pa.Array) -> pa.Array:
        ranks = ranks_at(path, pattern)
        heads, tails = [], []
        for window in windows:
            at = ranks.boundaries(window.as_py())
            heads.append([x for x in at if x <= overlap])
            tails.append([x - size for x in at if x >= size])
        lists = pa.list_(pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(heads, lists), pa.array(tails, lists)], ["head", "tail"]
        )

    unique = (
        docs.groupBy("doc_id", "text")
        .agg(F.count("*").alias("copies"))
        .withColumn("sha", F.sha2("text", 256))
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = _chunks(unique, size, overlap).repartition(width, "doc_id", "chunk")
    seen = chunks.withColumn("at", borders("window")).select("doc_id", "sha", "chunk", "at")
    before = seen.select(
        F.col("doc_id").alias("d"), F.col("sha").alias("s"),
        (F.col("chunk") + 1).alias("c"), F.col("at.tail").alias("tail"),
    )
    same = (
        seen["doc_id"].eqNullSafe(before["d"])
        & (seen["sha"] == before["s"])
        & (seen["chunk"] == before["c"])
    )
    cuts = seen.join(before, same, "left").select(
        "doc_id", "sha", "chunk",
        F.when(F.col("chunk") == 0, F.lit(0))
        .otherwise(F.array_min(F.array_intersect("at.head", "tail")))
        .alias("begin"),
    )
    # a document with a border where the two sides never agree is encoded as one chunk
    torn = cuts.groupBy("doc_id", "sha").agg(
        F.max(F.col("begin").isNull()).alias("torn"),
        F.map_from_entries(
            F.collect_list(F.struct("chunk", F.coalesce("begin", F.lit(0)).alias("begin")))
        ).alias("begins"),
    )
    ends = torn.select(
        F.col("doc_id").alias("d"), F.col("sha").alias("s"), "torn", "begins"
    )
    on = lambda left: left["doc_id"].eqNullSafe(ends["d"]) & (left["sha"] == ends["s"])
    pieces = (
        chunks.join(ends.filter(~F.col("torn")), on(chunks))
        .withColumn("begin", F.element_at("begins", F.col("chunk")))
        .withColumn(
            "end",
            F.when(F.col("last"), F.lit(size + overlap)).otherwise(
                F.element_at("begins", F.col("chunk") + 1) + size
            ),
        )
        .withColumn(
            "piece", F.substring("window", F.col("begin") + 1, F.col("end") - F.col("begin"))
        )
        .select("doc_id", "sha", "copies", "chunk", "piece")
    )
    whole = unique.join(ends.filter("torn"), on(unique)).select(
        "doc_id", "sha", "copies", F.lit(0).alias("chunk"), F.col("text").alias("piece")
    )
    return (
        pieces.unionByName(whole)
        .withColumn("ids", encode_column(F.col("piece"), path, pattern))
        .groupBy("doc_id", "sha", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    )


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 65_536,
    overlap: int = 1_024,
) -> DataFrame:
    """(id, ids) for every row; a null or empty text has no ids.

    Texts of one chunk are encoded where they are read. Longer ones become a row per
    chunk, so that one document's chunks run in parallel. Repeated rows and null ids
    give a row each; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    one_chunk = F.length("text") <= chunk_chars
    short = rows.filter(one_chunk).select(
        "doc_id", encode_column(F.col("text"), path, pattern).alias("ids")
    )
    long = _encode_long(rows.filter(~one_chunk), path, pattern, chunk_chars, overlap)
    return short.unionByName(long).withColumnRenamed("doc_id", id_col)
