"""Near duplicates by weighted MinHash of word shingles.

A text is a multiset of runs of five words. For each shingle, Poisson processes over
its discretised weight (the strata 0-1, 1-2, 2-4, 4-8, ...) throw points in rising
time on the components of a signature; inside the stratum that holds the weight, a
point counts if it lies below it. A component keeps its earliest point. Two texts
agree in a component with the probability of their weighted Jaccard similarity, and
because points come in order, most shingles are done after one.

Signatures are cut into bands. Texts that share a band are compared with one pivot of
that bucket, the one that shares most bands, on their whole multisets; links make
classes. Where a bucket is left with members of several classes, these texts are joined
on their rarest shingles, which finds every pair above the threshold whatever the pivot
was. Bounds on what a text can share with any other class are taken first, so that
texts of a large class that cannot reach another one make no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import release, runs_of, small_batches, stored, text_of, unused
from trackframe.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
#: Characters of text whose shingles are held at a time.
STEP = 500_000
CACHE_ENTRIES = 150_000
WORD = re.compile(r"\w+")
PRIME = np.uint64(0x100000001B3)
GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: WordHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs.

    Words are runs of letters, digits and underscores in lower case. A text of fewer
    than five words is one shingle, a text without words has none. ``known`` keeps hashes
    of words for the texts of one task.
    """
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = WordHashes() if known is None else known
    if len(known) > CACHE_ENTRIES:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    rolled = hashes[: len(words) - size + 1].copy()
    for k in range(1, size):
        rolled = mixed(rolled * PRIME + hashes[k : len(words) - size + 1 + k])
    return np.unique(rolled, return_counts=True)


def numbered(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th copy of a shingle is a token of its own."""
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mixed(np.repeat(elements, counts) + copy.astype(np.uint64) * GOLD))


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """(bags, size) signatures; empty bags have zeros."""
    earliest = np.full((len(bags), size), np.inf)
    element = np.concatenate([e for e, _ in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in bags]) if bags else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    # one process per shingle and stratum of weights that it reaches
    seeds, owners, lengths, rooms = [], [], [], []
    low, stratum = 0, 0
    while True:
        length = max(1, low)
        here = weight > low
        if not here.any():
            break
        seeds.append(mixed(element[here] + PRIME * np.full(1, stratum, np.uint64)))
        owners.append(owner[here])
        lengths.append(np.full(here.sum(), length, np.int64))
        rooms.append(weight[here] - low)
        low, stratum = low + length, stratum + 1
    if not seeds:
        return np.zeros((len(bags), size), np.uint64)
    seed, owner = np.concatenate(seeds), np.concatenate(owners)
    length, room = np.concatenate(lengths), np.concatenate(rooms)
    time = np.zeros(len(seed))
    turn = 0
    while len(seed):
        steps = GOLD * np.arange(2 * turn + 1, 2 * turn + 3, dtype=np.uint64)
        draw, other = mixed(seed + steps[0]), mixed(seed + steps[1])
        uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / (size * length)
        component = ((other >> np.uint64(40)) % np.uint64(size)).astype(np.int64)
        place = (other & np.uint64(0xFFFFFFFF)).astype(np.int64) * length >> 32
        counts = place < room
        np.minimum.at(earliest, (owner[counts], component[counts]), time[counts])
        limit = np.full(len(bags), -1.0)
        alive = np.unique(owner)
        limit[alive] = earliest[alive].max(axis=1)
        going = time < limit[owner]
        seed, owner, length, room, time = (x[going] for x in (seed, owner, length, room, time))
        turn += 1
    return np.where(np.isinf(earliest), 0, earliest).view(np.uint64)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64)
    for k in range(rows):
        keys = mixed(keys * PRIME + signatures[:, k::rows][:, :bands])
    return keys


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two numbered multisets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    return (batch.slice(run.start, run.stop - run.start) for run in runs_of(sizes, STEP))


def _signed(rows: DataFrame, bands: int, width: int) -> DataFrame:
    """doc_id, key, the multiset's digest hi and lo (null without words), band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for some in _steps(batch, "text"):
                yield sign_some(some, known)
        known.clear()
        release()

    def sign_some(batch: pa.RecordBatch, known: WordHashes) -> pa.RecordBatch:
        import xxhash

        bags = [shingles(t.as_py(), known) for t in batch.column("text")]
        found = band_keys(bag_minhash(bags, bands * width), bands, width).view(np.int64)
        high, low, keys = [], [], []
        for (elements, counts), row in zip(bags, found, strict=True):
            digest = xxhash.xxh3_128_digest(elements.tobytes() + counts.tobytes())
            empty = not len(elements)
            high.append(None if empty else int.from_bytes(digest[:8], "little", signed=True))
            low.append(None if empty else int.from_bytes(digest[8:], "little", signed=True))
            keys.append([] if empty else row)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("key"), pa.array(high, pa.int64()),
                pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "key", "hi", "lo", "keys"],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(
        sign, f"doc_id {kind}, key long, hi long, lo long, keys array<long>"
    )


def _tokens(rows: DataFrame) -> DataFrame:
    """node, label, n, token: one row for each token of the text of n tokens."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for some in _steps(batch, "text"):
                found = [numbered(*shingles(t.as_py(), known)) for t in some.column("text")]
                sizes = np.array([len(x) for x in found])
                again = pa.array(np.repeat(np.arange(len(found)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("node").take(again), some.column("label").take(again),
                        pa.array(np.repeat(sizes, sizes), pa.int64()),
                        pa.array(np.concatenate(found).view(np.int64)),
                    ],
                    names=["node", "label", "n", "token"],
                )
        release()

    return rows.select("node", "label", "text").mapInArrow(
        spell, "node long, label long, n long, token long"
    )


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, known = None, None, WordHashes()
        for batch in batches:
            kept = []
            for left, right in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                right = right.as_py()
                if right != last:  # pivots repeat
                    last, tokens = right, numbered(*shingles(right, known))
                own = numbered(*shingles(left.as_py(), known))
                kept.append(overlap(own, tokens) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
        release()

    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links; only the classes that these touch are worked on."""
    of = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(of, F.col(end) == F.col("n"), "left").select(
            *[F.coalesce("l", c).alias(c) if c == end else F.col(c) for c in ("a", "b")]
        )
    merged = stored(components(ends).withColumnRenamed("label", "root"), "merged")
    known = labels.join(merged.withColumnRenamed("node", "label"), "label", "left").select(
        "node", F.coalesce("root", "label").alias("label")
    )
    alone = merged.join(labels, "node", "left_anti").select("node", F.col("root").alias("label"))
    return known.unionByName(alone)


def _rare_pairs(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts of different classes that share one of their rarest shingles.

    Shingles are put in the order of how many classes have them. The first one that two
    texts above the threshold share stands so far in front, in both, that what follows
    is enough. ``rest`` has node and label.
    """
    tokens = stored(_tokens(texts.join(rest, "node")), "rest-tokens")
    seen = (
        tokens.select("token", "label").distinct()
        .groupBy("token").agg(F.count("*").alias("seen")).filter("seen > 1")
    )
    order = Window.partitionBy("node").orderBy("seen", "token")
    # tokens of one class alone come first: they take places, but make no pairs
    alone = F.coalesce(F.col("seen"), F.lit(1))
    placed = (
        tokens.join(stored(seen, "token-counts"), "token", "left").withColumn("seen", alone)
        .withColumn("place", F.row_number().over(order))
        .withColumn("shared", F.count(F.when(F.col("seen") > 1, 1)).over(Window.partitionBy("node")))
    )
    # a partner of m tokens needs (n + m) * t / (1 + t) common ones, and there are ``shared``
    reach = F.floor(F.col("shared") * F.lit((1 + threshold) / threshold) + 1e-9) - F.col("n")
    heads = stored(
        placed.filter(
            (F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
            & (F.col("seen") > 1)
        ).select("token", "node", "label", "n", "place", reach.alias("reach")),
        "rare-tokens",
    )
    heads = stored(_within_reach(heads), "reachable")
    mine = heads.select(
        "token", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"),
        F.col("reach").alias("ra"), F.col("place").alias("pa"),
    )
    other = heads.select(
        "token", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"),
        F.col("reach").alias("rb"), F.col("place").alias("pb"),
    )
    common = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    follow = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    return (
        mine.join(other, "token")
        .filter(
            (F.col("a") > F.col("b")) & (F.col("la") != F.col("lb"))
            & (F.col("nb") <= F.col("ra")) & (F.col("na") <= F.col("rb"))
            & (follow >= common)
        )
        .select("a", "b").distinct()
    )


def _within_reach(heads: DataFrame) -> DataFrame:
    """Rows whose token some text of another class has that is short enough for them,
    and some that reaches as far as they are long."""
    by_class = stored(
        heads.groupBy("token", "label").agg(F.min("n").alias("least"), F.max("reach").alias("most")),
        "token-classes",
    )
    first = by_class.groupBy("token").agg(
        F.min(F.struct("least", "label")).alias("short"), F.max(F.struct("most", "label")).alias("far")
    )
    second = (
        by_class.join(first, "token")
        .groupBy("token")
        .agg(
            F.first("short").alias("short"), F.first("far").alias("far"),
            F.min(F.when(F.col("label") != F.col("short.label"), F.col("least"))).alias("short2"),
            F.max(F.when(F.col("label") != F.col("far.label"), F.col("most"))).alias("far2"),
        )
        .filter("short2 is not null")
    )
    shortest = F.when(F.col("short.label") != F.col("label"), F.col("short.least")).otherwise(
        F.col("short2")
    )
    farthest = F.when(F.col("far.label") != F.col("label"), F.col("far.most")).otherwise(
        F.col("far2")
    )
    return (
        heads.join(stored(second, "token-reach"), "token")
        .filter((shortest <= F.col("reach")) & (farthest >= F.col("n")))
        .select(*heads.columns)
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, class_id, class_size, kept) for every row.

    Classes are the connected components of links, texts whose multisets of word
    5-shingles have a weighted Jaccard similarity of ``threshold`` or more;
    ``class_id`` is the smallest id of the class, and one of its rows is kept. A
    text without words is a class of its own. Equal multisets are one node, so copies
    are never compared. Null ids are the greatest; rows that repeat id and text are
    members one by one. Other columns are not read; an empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, threshold, bands, rows).drop("wordless")


def _judged(
    docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int
) -> DataFrame:
    """As :func:`near_duplicates`; ``wordless`` marks texts without words."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    key = F.xxhash64("text").alias("key")
    signed = stored(
        _signed(base.select("doc_id", key, "text"), bands, rows), "signatures"
    )
    some = signed.filter("hi is not null")
    nodes = stored(
        some.groupBy("hi", "lo").agg(
            F.first("keys").alias("keys"), F.count("*").alias("copies"),
            F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "key")).alias("one"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = nodes.select("node", F.posexplode("keys").alias("band", "bucket"))
    shared = stored(
        banded.groupBy("band", "bucket").agg(F.count("*").alias("size")).filter("size > 1"),
        "buckets",
    )
    members = stored(banded.join(shared, ["band", "bucket"]), "members")
    central = stored(members.groupBy("node").agg(F.sum("size").alias("ties")), "ties")
    pivots = (
        members.join(central, "node").groupBy("band", "bucket")
        .agg(F.max(F.struct("ties", "node")).alias("pivot"))
        .select("band", "bucket", F.col("pivot.node").alias("pivot"))
    )
    members = stored(
        members.join(stored(pivots, "pivots"), ["band", "bucket"]).drop("size"), "members"
    )
    wanted = members.select("node").distinct().join(nodes.select("node", "one"), "node")
    texts = stored(
        base.withColumn("key", F.xxhash64("text")).alias("t")
        .join(
            wanted.alias("w"),
            F.col("t.doc_id").eqNullSafe(F.col("w.one.doc_id"))
            & (F.col("t.key") == F.col("w.one.key")),
        )
        .select("node", "text").dropDuplicates(["node"]),
        "texts",
    )
    pairs = members.filter("node != pivot").select(
        F.col("node").alias("a"), F.col("pivot").alias("b")
    ).distinct()
    links = stored(_links(pairs, texts, threshold), "links")
    labels = stored(components(links), "labels")
    torn = (
        _labelled(members, labels).groupBy("band", "bucket")
        .agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
        .select("band", "bucket")
    )
    rest = stored(
        members.join(stored(torn, "torn"), ["band", "bucket"]).select("node").distinct(), "rest"
    )
    if rest.limit(1).count():
        pairs = _rare_pairs(_labelled(rest, labels), texts, threshold)
        more = stored(_links(pairs, texts, threshold), "more-links")
        labels = _joined_classes(labels, more)
    classed = nodes.select("node", "hi", "lo", "copies", "least_id").join(labels, "node", "left")
    classed = stored(classed.withColumn("label", F.coalesce("label", "node")), "classed")
    classes = stored(
        classed.groupBy("label").agg(
            F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size")
        ),
        "classes",
    )
    named = stored(
        classed.join(classes, "label").select("hi", "lo", "label", "class_id", "class_size"), "named"
    )
    # rows of one id and text are told apart by a number, to keep one of them
    counted = some.groupBy("doc_id", "key", "hi", "lo").agg(F.count("*").alias("rows"))
    in_class = counted.join(named, ["hi", "lo"])
    first = (
        in_class.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy(F.col("label").alias("of")).agg(F.min("key").alias("kept_key"))
    )
    marked = in_class.join(
        stored(first, "first"),
        (F.col("label") == F.col("of")) & (F.col("key") == F.col("kept_key"))
        & F.col("doc_id").eqNullSafe(F.col("class_id")),
        "left",
    ).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    kept = F.col("of").isNotNull() & (F.col("copy") == 1)
    alone = signed.filter("hi is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(True).alias("kept"), "key", F.lit(True).alias("wordless"),
    )
    return (
        marked.select(
            "doc_id", "class_id", "class_size", kept.alias("kept"), "key",
            F.lit(False).alias("wordless"),
        )
        .unionByName(alone)
        .withColumnRenamed("doc_id", id_col)
    )


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """The rows that stay, with all their columns, as :func:`near_duplicates` says.

    Of rows that repeat id and text, those without words all stay, of others one does.
    """
    key, row, of_id, of_key, wordless = (
        unused(docs, n) for n in ("key_", "row_", "of_id_", "of_key_", "wordless_")
    )
    kept = (
        _judged(docs, id_col, text_col, threshold, bands, rows).filter("kept")
        .select(
            F.col(id_col).alias(of_id), F.col("key").alias(of_key), F.col("wordless").alias(wordless)
        )
        .distinct()
    )
    tagged = docs.withColumn(key, F.xxhash64(text_of(text_col)))
    same = (tagged[key] == kept[of_key]) & tagged[id_col].eqNullSafe(kept[of_id])
    once = tagged.join(kept, same).withColumn(
        row, F.when(F.col(wordless), F.monotonically_increasing_id())
    )
    return once.dropDuplicates([key, id_col, row]).select(*[docs[c] for c in docs.columns])
