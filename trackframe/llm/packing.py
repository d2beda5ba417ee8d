"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. Every window takes from each queue
what its share of the mixture comes to, and whole tokens only: what a queue gets too
little in one window it is owed in the next. Which queue is served next depends on
how far each is behind, (tokens taken + 1/2) / weight, so what has been taken before
any window is a function of the window's position alone. Deficits are therefore
carried over windows and partitions without a pass in order: every document finds
its windows by itself, once its offset in its queue is known.

Documents are cut at window borders. All windows are full; what is left at the end
goes to windows of falling powers of two, so that nothing is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import runs_of, shuffle_width, stored, text_of

LENGTH = 4096
END = 2
#: Queues that one schedule serves, and one more for all smaller sources together,
#: which are scheduled in it in the same way.
QUEUES = 255
#: Windows whose queues are worked out together.
WINDOWS = 2_048
#: Bytes of texts whose words are collected before they are encoded.
STEP = 6_000_000
#: Documents whose pieces are worked out together.
DOCUMENTS = 500
_LOADED: dict = {}


class WordTokens:
    """A tokenizer of words with end marks, applied to each distinct word of a batch.

    A run of letters, a number sign or a run of other signs is a piece; white space is
    dropped. Words of plain Latin signs go through a rank encoder with the same merges,
    the last byte of a piece being followed by a byte that no text has; all others go
    through the library as they are, as do whole texts for any other kind of tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path) as file:
            spec = json.load(file)
        self.ranks = _ranks(spec)
        added = [regex.escape(t["content"]) for t in spec.get("added_tokens") or []]
        # they are found before a text is split, also inside words
        self.added = "|".join(added)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, then END."""
        if self.ranks is None:
            return [np.array([*self._library(t), END], self.kind) for t in texts.to_pylist()]
        if self.added:
            whole = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
            if whole.any():
                rest = iter(self._by_words(texts.filter(pa.array(~whole))))
                return [
                    np.array([*self._library(texts[i].as_py()), END], self.kind) if apart else next(rest)
                    for i, apart in enumerate(whole.tolist())
                ]
        return self._by_words(texts)

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        distinct = split.flatten().dictionary_encode()
        flat, begins, sizes = self._words(distinct.dictionary.to_pylist())
        run = distinct.indices.to_numpy()
        stops = np.cumsum(sizes[run])
        total = int(stops[-1]) if len(run) else 0
        ids = flat[_spread(begins[run] - stops + sizes[run], sizes[run], total)]
        ends = np.concatenate([[0], stops])[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        ids = np.insert(ids, ends, END)
        return np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1]) if len(ends) else []

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, and where those of each word begin and how many they are."""
        other = [i for i, w in enumerate(words) if not PLAIN.fullmatch(w)]
        apart = [np.array(self._library(words[i]), self.kind) for i in other]
        lines = words.copy()
        for i in other:
            lines[i] = ""
        lines.append("")
        pieces = pa.array(PIECE.findall("\n".join(lines).lower())).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        encode = self.ranks._encode_single_piece
        found = [[] if p == "\n" else encode(p.encode() + LAST) for p in known]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.kind, lengths.sum())
        codes = pieces.indices.to_numpy()
        stops = np.cumsum(lengths[codes])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[codes]
        flat = ids[_spread(starts - stops + lengths[codes], lengths[codes], int(stops[-1]))]
        # each word ends with its line; those of other kinds follow behind
        ends = stops[codes == known.index("\n")] if words else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sizes = ends - begins
        behind = len(flat)
        for i, own in zip(other, apart, strict=True):
            begins[i], sizes[i] = behind, len(own)
            behind += len(own)
        return np.concatenate([flat, *apart]).astype(self.kind), begins, sizes


def _spread(shift: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """0, 1, 2, ... with each run of ``sizes`` shifted."""
    kind = np.int32 if total < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat(shift.astype(kind), sizes)


#: How the tokenizer file splits words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = regex.compile(rf"\n|{SPLIT}")
#: Signs that no normal form changes and that every version of Unicode sorts alike.
PLAIN = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+")
LAST = b"\xff"


def _ranks(file: dict):
    """A rank encoder with the merges of a tokenizer file; None for other kinds.

    Words end in a mark there. Here the mark is a byte, and a byte with its mark is
    among the first 512 ids, so it is put together before any merge.
    """
    import tiktoken

    model, split = file["model"], file["pre_tokenizer"]
    vocabulary = model["vocab"]
    steps = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if (
        model.get("end_of_word_suffix") != "</w>"
        or split.get("pretokenizers", [{}])[0].get("pattern") != {"Regex": SPLIT}
        or [n["type"] for n in file["normalizer"].get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]
        or [vocabulary[s] for s in steps] != list(range(512, 512 + len(steps)))
    ):
        return None
    # the byte alphabet: printable signs stand for themselves, the others follow from 256 on
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs += [b for b in range(256) if b not in set(signs)]
    letters = {chr(b if k < 188 else 256 + k - 188): b for k, b in enumerate(signs)}
    ranks = {}
    for token, rank in vocabulary.items():
        last = token.endswith("</w>")
        data = bytes(letters[c] for c in (token[:-4] if last else token))
        ranks[data + LAST if last else data] = rank
    return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def tokens_at(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


class Schedule:
    """What each queue has given before each window border.

    A queue can be a schedule of its own (``inner``, by queue): its tokens are then
    in its own order, and it is behind as the sum of its queues is.
    """

    def __init__(
        self, totals: list[int], weights: list[float] | None = None,
        inner: dict[int, Schedule] | None = None,
    ):
        self.totals = np.array(totals, np.int64)
        weights = np.array(totals if weights is None else weights, float)
        self.weights = np.where(self.totals > 0, np.maximum(weights, 1e-12), 1.0)
        self.total = int(self.totals.sum())
        # served in step with the weights, queues run dry in this order
        self.dry = np.sort(self.totals / self.weights)
        self.by_then = np.minimum(self.totals[None, :], self.dry[:, None] * self.weights).sum(axis=1)
        self.inner = inner or {}
        if self.inner:
            plain = [q for q in range(len(self.totals)) if q not in self.inner]
            own = self.totals[plain] / self.weights[plain]
            self.dry = np.unique(np.concatenate([own, *(x.dry for x in self.inner.values())]))
            self.by_then = sum(self._given(self.dry, q) for q in range(len(self.totals)))
        self.times = np.concatenate([[0.0], self.dry])
        self.served = np.concatenate([[0.0], self.by_then])

    def _given(self, time: np.ndarray, queue: int) -> np.ndarray:
        """What a queue has given by a time, in parts of tokens."""
        if queue in self.inner:
            return np.interp(time, self.inner[queue].times, self.inner[queue].served)
        return np.minimum(self.totals[queue], time * self.weights[queue])

    def _time(self, tokens: np.ndarray) -> np.ndarray:
        """(rows, queues): when each queue has given so many tokens."""
        out = tokens / self.weights
        for q, x in self.inner.items():
            out[:, q] = np.interp(tokens[:, q], x.served, x.times)
        return out

    def borders(self, windows: np.ndarray) -> np.ndarray:
        """First token of each window in the packed order; past the last, the total."""
        full, rest = divmod(self.total, LENGTH)
        tail = [0]
        for bit in range(LENGTH.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        tail = np.array(tail) + full * LENGTH
        return np.where(
            windows <= full, windows * LENGTH, tail[np.clip(windows - full, 0, len(tail) - 1)]
        )

    def window_of(self, position: np.ndarray) -> np.ndarray:
        """The window of a position in the packed order."""
        full, rest = divmod(self.total, LENGTH)
        left = np.maximum(position - full * LENGTH, 0)
        tail, at = np.zeros(len(position), np.int64), 0
        for bit in range(LENGTH.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                at += 1 << bit
                tail += left >= at
        return np.where(position < full * LENGTH, position // LENGTH, full + tail)

    def taken(self, borders: np.ndarray) -> np.ndarray:
        """(borders, queues): tokens taken from each queue before each border.

        The first ``border`` tokens of all queues in order of (index + 1/2) / weight,
        ties to the earlier queue.
        """
        need = np.asarray(borders, np.int64)
        time = np.interp(need, self.served, self.times)
        given = time[:, None] * self.weights
        for q in self.inner:
            given[:, q] = self._given(time, q)
        got = np.clip(np.floor(given + 0.5), 0, self.totals).astype(np.int64)
        last = len(self.totals) - 1
        while True:
            following = np.where(got < self.totals, self._time(got + 0.5), np.inf)
            latest = np.where(got > 0, self._time(got - 0.5), -np.inf)
            first = following.argmin(axis=1)
            final = last - latest[:, ::-1].argmax(axis=1)
            rows = np.arange(len(need))
            short = need - got.sum(axis=1)
            a, b = following[rows, first], latest[rows, final]
            swap = (short == 0) & ((b > a) | ((b == a) & (final > first)))
            add, remove = (short > 0) | swap, (short < 0) | swap
            if not (add.any() or remove.any()):
                return got
            got[rows[add], first[add]] += 1
            got[rows[remove], final[remove]] -= 1

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Of many runs of queues' tokens: (run, window, offset in it, start in queue, length)."""
        # a queue is never further from its share than one token per queue
        slack = len(self.totals) + 2
        ends = np.stack([start, start + length - 1])
        at = np.interp(
            (ends + 0.5) / self.weights[queue],
            self.times, self.served,
        )
        at[0] -= slack
        at[1] += slack
        low, high = (
            self.window_of(np.clip(x, 0, max(self.total - 1, 0)).astype(np.int64)) for x in at
        )
        count = high - low + 1
        run = np.repeat(np.arange(len(queue)), count)
        window = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        known = np.unique(np.concatenate([window, window + 1]))
        taken = self.taken(self.borders(known))
        here, there = np.searchsorted(known, window), np.searchsorted(known, window + 1)
        given = taken[there] - taken[here]
        before = (np.cumsum(given, axis=1) - given)[np.arange(len(run)), queue[run]]
        first = taken[here, queue[run]]
        begin = np.maximum(first, start[run])
        stop = np.minimum(taken[there, queue[run]], (start + length)[run])
        keep = stop > begin
        return tuple(
            x[keep] for x in (run, window, before + begin - first, begin, stop - begin)
        )


class Mixture:
    """A schedule of any number of queues, as a tree of schedules of a few each.

    The first QUEUES queues are served by the root. The others are sorted by when they
    run dry and dealt into at most QUEUES groups, groups of groups if need be, which
    share one queue of the root. All levels keep the same time, so a group is served
    as its queues come to together, also when some of them have run dry.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        sizes = np.array(totals, np.int64)
        shares = np.array(totals if weights is None else weights, float)
        #: of each queue, the schedules from the root on and its place in each of them
        self.path: list[list[tuple[Schedule, int]]] = [[] for _ in totals]
        first, rest = np.arange(len(sizes))[:QUEUES], np.arange(len(sizes))[QUEUES:]
        dry = sizes[rest] / np.maximum(shares[rest], 1e-12)
        rest = rest[np.argsort(dry, kind="stable")]
        self.root = self._node(sizes, shares, list(first), [rest] if len(rest) else [])

    def _node(self, sizes, shares, own: list[int], groups: list[np.ndarray]) -> Schedule:
        inner = {}
        for place, group in enumerate(groups, len(own)):
            if len(group) <= QUEUES:
                inner[place] = self._node(sizes, shares, group.tolist(), [])
            else:
                parts = np.array_split(group, min(QUEUES, -(-len(group) // QUEUES)))
                inner[place] = self._node(sizes, shares, [], parts)
        node = Schedule(
            [int(sizes[q]) for q in own] + [x.total for x in inner.values()],
            [float(shares[q]) for q in own] + [1.0] * len(inner), inner,
        )
        for place, queue in enumerate(own):
            self.path[queue].append((node, place))
        for place, group in enumerate(groups, len(own)):
            for queue in group.tolist():
                self.path[queue].append((node, place))
        return node

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray):
        """As ``Schedule.pieces``, for queues at any level."""
        leaf = {q: self.path[q] for q in np.unique(queue).tolist()}
        at_home: dict[int, list[int]] = {}
        for q, path in leaf.items():
            at_home.setdefault(id(path[0][0]), []).append(q)
        found = []
        for queues in at_home.values():
            path = leaf[queues[0]][::-1]  # from the root
            runs = np.flatnonzero(np.isin(queue, queues))
            place = np.array([leaf[q][0][1] for q in queue[runs].tolist()], np.int64)
            if len(path) == 1:
                got = self.root.pieces(place, start[runs], length[runs])
                found.append((runs[got[0]], *got[1:]))
            else:
                found += self._below(path, runs, place, start[runs], length[runs])
        parts = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(parts[0], kind="stable")
        return tuple(x[order] for x in parts)

    def _below(self, path, runs, place, start, length) -> list[tuple]:
        low, high = self._windows(path, place, start, length)
        found = []
        # windows in steps, so that the size of what is held does not grow with a run
        for base in range(int(low.min()), int(high.max()) + 1, WINDOWS):
            begin, end = np.maximum(low, base), np.minimum(high, base + WINDOWS - 1)
            some = np.flatnonzero(end >= begin)
            if not len(some):
                continue
            known = np.arange(begin[some].min(), end[some].max() + 2)
            border = self.root.borders(known)
            before = np.zeros(len(known) - 1, np.int64)
            for node, at in path[:-1]:
                taken = node.taken(border)
                before += np.diff(taken[:, :at].sum(axis=1))
                border = taken[:, at]
            taken = path[-1][0].taken(border)
            given = np.diff(taken, axis=0)
            ahead = np.cumsum(given, axis=1) - given + before[:, None]
            for run in some.tolist():  # windows of one run are a slice
                q, i, j = place[run], begin[run] - known[0], end[run] + 1 - known[0]
                first = np.maximum(taken[i:j, q], start[run])
                stop = np.minimum(taken[i + 1 : j + 1, q], start[run] + length[run])
                keep = np.flatnonzero(stop > first)
                offset = ahead[i:j, q] + first - taken[i:j, q]
                found.append((
                    np.full(len(keep), runs[run]), known[i:j][keep], offset[keep],
                    first[keep], (stop - first)[keep],
                ))
        return found

    def _windows(self, path, place, start, length):
        """The first and last window that a run of each queue can have tokens in."""
        ends = []
        for token, way in ((start, -1), (start + length - 1, 1)):
            leaf = path[-1][0]
            time = (token + 0.5) / leaf.weights[place]
            for node, _ in path[::-1]:
                # a queue is never further from its share than one token per queue
                at = np.interp(time, node.times, node.served) + way * (len(node.totals) + 2)
                time = np.interp(at, node.served, node.times)
            ends.append(self.root.window_of(np.clip(at, 0, self.root.total - 1).astype(np.int64)))
        return ends


def token_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, sha, source, ids: the ids of each text, in as few bytes as they need."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_at(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for run in runs_of(sizes, STEP):
                some = batch.slice(run.start, run.stop - run.start)
                ids = [x.tobytes() for x in tokens.encode(some.column("text"))]
                yield some.select(["doc_id", "sha", "source"]).append_column(
                    "ids", pa.array(ids, pa.binary())
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "sha", "source", "text").mapInArrow(
        encode, f"doc_id {kind}, sha long, source string, ids binary"
    )


def _queue_offsets(counts: DataFrame, blocks: int) -> DataFrame:
    """``start`` of each document in its queue, in order of (block, doc_id, sha).

    A block is a hash of the document, so no queue is walked as a whole: blocks are
    summed first, and only their sums meet per queue.
    """
    inside = (
        Window.partitionBy("queue", "block").orderBy("doc_id", "sha")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        counts.groupBy("queue", "block").agg(F.sum(F.col("n") * F.col("copies")).alias("sum"))
        .select("queue", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    )
    return (
        counts.withColumn(
            "local",
            F.sum(F.col("n") * F.col("copies")).over(inside) - F.col("n") * F.col("copies"),
        )
        .join(stored(sums, "queue-blocks"), ["queue", "block"])
        .select("doc_id", "sha", "queue", "n", "copies", (F.col("base") + F.col("local")).alias("start"))
    )


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame,
    path: str,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in windows of LENGTH tokens.

    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source). A null
    text is empty and has its end token alone; a null source is a queue of its own. Repeated rows
    are packed one by one. ``targets`` gives the weights of sources in the mixture;
    by default each has its share of all tokens, so that every window has the
    mixture of the whole. A source without a target has weight 1. When a queue runs
    dry the others share its place. This holds for any number of sources; their names
    and token counts are held by the driver and by each task. An empty table has no
    pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"),
        F.col(source_col).cast("string").alias("source"),
    ).withColumn("sha", F.xxhash64("text", "source"))
    width = np.dtype(tokens_at(path).kind).itemsize
    rows = stored(
        token_ids(rows, path)
        .withColumn("n", (F.octet_length("ids") / width).cast("long")),
        "token-ids",
    )
    counts = rows.groupBy("doc_id", "sha", "source").agg(
        F.max("n").alias("n"), F.count("*").alias("copies")
    )
    counts = stored(counts, "token-counts")
    tokens = F.sum(F.col("n") * F.col("copies"))
    own = [
        (r["source"], int(r["tokens"]))
        for r in counts.groupBy("source").agg(tokens.alias("tokens"))
        .orderBy(F.desc("tokens"), "source").collect()
    ]
    weights = [targets.get(s, 1.0) for s, _ in own] if targets else None
    schedule = spark.sparkContext.broadcast(Mixture([n for _, n in own], weights))
    queues = spark.createDataFrame(
        [(s, k) for k, (s, _) in enumerate(own)], "known string, queue int"
    )
    of_source = counts.join(
        F.broadcast(queues), counts["source"].eqNullSafe(queues["known"])
    ).drop("known")
    blocks = max(4 * shuffle_width(spark), 64)
    placed = _queue_offsets(
        of_source.withColumn("block", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(blocks))),
        blocks,
    )

    kind = tokens_at(path).kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                yield cut_some(batch.slice(at, DOCUMENTS))

    def cut_some(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x.as_py(), kind).astype("<u4") for x in batch.column("ids")]
        queue, copies, start = (
            batch.column(name).to_numpy() for name in ("queue", "copies", "start")
        )
        sizes = np.array([len(x) for x in ids])
        # the copies of a document follow each other in its queue
        row = np.repeat(np.arange(len(ids)), copies)
        copy = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        first = start[row] + copy * sizes[row]
        run, window, offset, begin, length = schedule.value.pieces(queue[row], first, sizes[row])
        own = row[run]
        a = begin - first[run]
        views = [memoryview(x).cast("B") for x in ids]
        crc = np.array(
            [zlib.crc32(views[d][4 * i : 4 * j]) for d, i, j in
             zip(own.tolist(), a.tolist(), (a + length).tolist(), strict=True)], np.int64
        )
        numbers = (a, length, crc, sizes[own], window, offset)
        return pa.RecordBatch.from_arrays(
            [batch.column(name).take(pa.array(own)) for name in ("key", "source")]
            + [pa.array(x.astype(np.int64)) for x in numbers],
            names=["key", "source", *PIECES],
        )

    def with_place(found: DataFrame) -> DataFrame:
        found = found.select(
            F.col("doc_id").alias("d"), F.col("sha").alias("s"), "queue", "copies", "start"
        )
        same = rows["doc_id"].eqNullSafe(found["d"]) & (rows["sha"] == found["s"])
        return rows.join(found, same)

    joined = with_place(placed.filter("copies = 1"))
    if counts.filter("copies > 1").limit(1).count():  # rows that repeat id and text
        again = with_place(placed.filter("copies > 1")).dropDuplicates(["d", "s"])
        joined = joined.unionByName(again)
    types = docs.schema[id_col].dataType.simpleString()
    columns = ", ".join(f"`{name}` long" for name in PIECES)
    return (
        joined.select(F.col("doc_id").alias("key"), "source", "ids", "queue", "copies", "start")
        .mapInArrow(cut, f"key {types}, source string, {columns}")
        .select(F.col("key").alias(id_col), *PIECES, "source")
    )
