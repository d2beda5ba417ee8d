"""How far the sources of a language differ, by run-length columns.

Terms that enough documents of a language hold are its vocabulary. A source is a
column of counts along that vocabulary. The vocabulary is ordered so that terms with
equal counts stand together, cut into blocks, and each column of a block is kept as
runs (end, count). Two sources are compared run by run: the borders of their runs are
merged, and what one term of a merged run adds is multiplied by the length of the run.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import shuffle_width, stored, text_of

#: A language keeps the terms of so many of its documents.
LEAST_DOCUMENTS = 10
#: Ranks of the terms that stand out.
TOP_TERMS = 10
#: Shares are counted in parts of this, plus one; a step of its long division.
PARTS, STEP = 1_000_000_000, 1_000
#: Terms of a block of the vocabulary.
BLOCK = 2_048
#: Columns that are compared with each other in one go.
TILE = 64
#: Distinct terms that a task counts before it passes them on.
HELD = 300_000
#: Bytes of a text that are split at once.
SLICE = 4_000_000

#: Letters of ASCII in lower case and all bytes above; everything else is a gap.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, some megabytes at a time."""
    start = 0
    while start < len(text):
        stop = start + SLICE
        while stop < len(text) and LETTERS[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(LETTERS).split()
        start = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed as far as one task holds."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    added = 0
    for batch in batches:
        langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
        for lang, source, text in zip(langs, sources, batch["text"], strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _terms(text.as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            added += len(seen) + 1
            if added > HELD:
                added = sum(len(n) + 1 for n, _ in groups.values())
                if added > HELD:
                    yield from _counted(groups)
                    groups, added = {}, 0
    yield from _counted(groups)


def _counted(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang, pa.string()), len(n)),
                    pa.repeat(pa.scalar(source, pa.string()), len(n)),
                    pa.array(n.keys(), pa.binary()),
                    pa.array(n.values(), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def vocabulary(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n, found) of the terms in at least ``least`` documents of a language.

    ``found`` holds (source, n) of each source that has the term, by name.
    """
    counted = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        _count, "lang string, source string, term binary, n long, docs long"
    )
    # one shuffle serves both sums
    dealt = counted.repartition(shuffle_width(rows.sparkSession), "lang", "term")
    return (
        dealt.groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("source", "n"))).alias("found"),
        )
        .filter(F.col("docs") >= least)
        .select("lang", F.col("term").cast("string").alias("term"), "n", "found")
    )


def _groups(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, idx, n, lang_n, v, sources) of every group, without terms too."""
    own = kept.select("lang", F.explode("found").alias("f")).groupBy(
        "lang", F.col("f.source").alias("source")
    ).agg(F.sum("f.n").alias("n"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    none = F.lit(0).cast("long")
    lang = Window.partitionBy("lang")
    return (
        rows.select("lang", "source").distinct()
        .join(own, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .fillna(0, ["n", "v", "lang_n"])
        .select(
            "lang", "source",
            (F.row_number().over(lang.orderBy("source")) - 1).alias("idx"),
            *[F.coalesce(c, none).alias(c) for c in ("n", "lang_n", "v")],
            F.count("*").over(lang).alias("sources"),
        )
    )


def _encode(
    batches: Iterator[pa.RecordBatch], most: int = BLOCK
) -> Iterator[pa.RecordBatch]:
    """Ordered (lang, found) -> (lang, block, length, source, ends, counts)."""
    number = TaskContext.get().partitionId() << 32
    lang, lists = None, []

    def block():
        nonlocal number
        number += 1
        found = pa.chunked_array(lists).combine_chunks()
        sizes = np.diff(found.offsets.to_numpy())
        at = np.repeat(np.arange(len(sizes)), sizes)
        flat = found.flatten()
        names = flat.field("source").dictionary_encode()
        codes, n = names.indices.to_numpy(), flat.field("n").to_numpy()
        order = np.argsort(codes, kind="stable")
        borders = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
        ends, counts = [], []
        for a, b in zip(borders, borders[1:], strict=False):
            column = np.zeros(len(sizes), np.int64)
            column[at[order[a:b]]] = n[order[a:b]]
            last = np.append(np.flatnonzero(np.diff(column)), len(column) - 1)
            ends.append(last + 1)
            counts.append(column[last])
        rows = len(ends)
        return pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(lang, pa.string()), rows),
                pa.repeat(pa.scalar(number, pa.int64()), rows),
                pa.repeat(pa.scalar(len(sizes), pa.int64()), rows),
                names.dictionary.cast(pa.string()),
                pa.array(ends, pa.list_(pa.int64())),
                pa.array(counts, pa.list_(pa.int64())),
            ],
            ["lang", "block", "length", "source", "ends", "counts"],
        )

    held = 0
    for batch in batches:
        langs = batch["lang"].to_pylist()
        start = 0
        while start < len(langs):
            if lists and (langs[start] != lang or held == most):
                yield block()
                lists, held = [], 0
            lang = langs[start]
            stop = start
            while stop < len(langs) and langs[stop] == lang and held < most:
                stop, held = stop + 1, held + 1
            lists.append(batch["found"].slice(start, stop - start))
            start = stop
    if lists:
        yield block()


def run_columns(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of all sources as runs, block by block of the ordered vocabulary.

    Terms that the same sources hold equally often are neighbours. ``ends`` counts from
    the start of the block; a source without terms in a block has no row.
    """
    parts = max(1, -(-kept.count() // block))
    # dealt by the first count and a hash of the rest: what the driver samples stays short
    dealt = kept.repartitionByRange(
        parts, "lang", F.col("found")[0], F.xxhash64("found"), F.xxhash64("term")
    )
    ordered = dealt.sortWithinPartitions("lang", "found", "term")
    return ordered.select("lang", "found").mapInArrow(
        partial(_encode, most=block),
        "lang string, block long, length long, source string, ends array<long>, counts array<long>",
    )


def _shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 2) / (n + 2 * v)), by long division, for any counts."""
    whole, rest, found = n + 2 * v, counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * STEP
        found, rest = found * STEP + rest // whole, rest % whole
    return found + 1


def share(count: Column, n: Column, v: Column) -> Column:
    """As :func:`_shares`, in SQL."""
    whole, rest, found = n + 2 * v, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * STEP
        found, rest = found * STEP + F.call_function("div", rest, whole), rest % whole
    return found + 1


def _compare(table: pa.Table, tile: int = TILE) -> pa.Table:
    """All pairs of columns of two tiles in one block: (lang, a, b, value)."""
    lang, length = table["lang"][0].as_py(), table["length"][0].as_py()
    tiles = (table["ta"][0].as_py(), table["tb"][0].as_py())
    columns = []
    for row in table.select(["idx", "source", "n", "v", "ends", "counts"]).to_pylist():
        ends = np.array([length] if row["ends"] is None else row["ends"], np.int64)
        counts = np.array([0] if row["counts"] is None else row["counts"], np.int64)
        p = _shares(counts, row["n"], row["v"]) if length else counts
        columns.append((row["idx"], row["source"], ends, p))
    columns.sort(key=lambda c: c[0])
    left = [c for c in columns if c[0] // tile == tiles[0]]
    right = [c for c in columns if c[0] // tile == tiles[1]]
    a, b, values = [], [], []
    for i, name, ends, p in left:
        for j, other, their, q in right:
            if i >= j:
                continue
            a.append(name)
            b.append(other)
            if not length:
                values.append(0)
                continue
            merged = np.union1d(ends, their)
            p_at, q_at = p[np.searchsorted(ends, merged)], q[np.searchsorted(their, merged)]
            apart = p_at - q_at
            values.append(int((apart * apart // (p_at + q_at) * np.diff(merged, prepend=0)).sum()))
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "a": pa.array(a, pa.string()),
            "b": pa.array(b, pa.string()),
            "value": pa.array(values, pa.int64()),
        }
    )


def _pairs(groups: DataFrame, cells: DataFrame, tile: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways."""
    blocks = (
        cells.select("lang", "block", "length").distinct()
        .groupBy("lang").agg(F.collect_list(F.struct("block", "length")).alias("blocks"))
    )
    # a block without terms gives the pairs of languages that keep none
    empty = F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("length")))
    grid = (
        groups.join(blocks, "lang", "left")
        .select(
            "lang", "source", "idx", "n", "v", "sources",
            F.inline(F.concat(empty, F.coalesce("blocks", F.slice(empty, 1, 0)))),
        )
        .join(cells.drop("length"), ["lang", "block", "source"], "left")
    )
    own = F.floor(F.col("idx") / tile).cast("int")
    tiles = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / tile).cast("int"))
    dealt = (
        grid.withColumn("tile", own).withColumn("other", F.explode(tiles))
        .withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other"))
        .drop("tile", "other")
    )
    compare = lambda table: _compare(table, tile)
    sums = (
        dealt.groupBy("lang", "block", "ta", "tb")
        .applyInArrow(compare, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return sums.select("lang", F.inline(both), "value")


def _standing_out(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that a source has more of than its language."""
    p, q = F.col("p"), F.col("q")
    return (
        kept.select("lang", F.col("term").alias("item"), F.col("n").alias("all"), F.inline("found"))
        .withColumnRenamed("n", "own")
        .join(groups, ["lang", "source"])
        .select(
            "lang", "source", "item",
            share(F.col("own"), F.col("n"), F.col("v")).alias("p"),
            share(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"),
        )
        .filter(p > q)
        .select(
            "lang", "source", "item",
            F.call_function("div", (p - q) * (p - q), p + q).alias("value"),
        )
    )


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms
    that stand out against the language. Null texts, languages and sources are empty
    strings, which are names like others. Rows that repeat count one by one. A language
    that keeps no term has pairs of value 0; one with a single source has no pairs. Ties
    go by the bytes of the item. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(
        text_of(lang_col).alias("lang"), text_of(source_col).alias("source"),
        text_of(text_col).alias("text"),
    )
    kept = stored(vocabulary(rows, least), "vocabulary")
    groups = stored(_groups(rows, kept), "groups")
    pairs = _pairs(groups, stored(run_columns(kept, block), "run-columns"), tile)
    rank = F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    )

    def ranked(found: DataFrame, part: str) -> DataFrame:
        return found.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")
        )

    terms = ranked(_standing_out(groups, kept), "term").filter(F.col("rank") <= top)
    return ranked(pairs, "pair").unionByName(terms)
