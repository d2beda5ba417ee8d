"""Scores of texts under a weighted backoff automaton.

Tokens are words and one end per text. The automaton of order n has a state for each
context of up to n - 1 tokens that was seen in training. A state has an arc for each
token that followed it, with probability (c(hw) + K p(w|h')) / (c(h) + K), where h' is
the context without its first token, and a failure arc to the state of h' with weight
K / (c(h) + K). The state without a context has an arc for every token, by add-one
smoothing. Each state's probabilities sum to one.

Counts come from all training texts. Documents are dealt into blocks; a block sends
each of its distinct n-grams once, with its count, to the bucket of the n-gram;
buckets add up and answer each block with what other blocks have counted. No task
holds the whole model, and however frequent an n-gram is, it has one entry per block.
Then each block sets up its part of the automaton and walks its texts through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import shuffle_width, text_of

ORDER = 3
#: K of the orders from 2 on.
PRIOR = 16.0
#: Tokens in a block of documents; bounds what a task holds.
BLOCK_TOKENS = 2_000_000
END = np.uint64(0x5851F42D4C957F2D)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Keys of several words are cut to 48 bits, to travel in four bytes each. Of n such
#: keys about one in 2**49 / n shares its place with another; words keep all bits.
CUT = np.uint64(16)


def words_of(text: str) -> list[bytes]:
    """Bytes in lower case have A-Z changed, and split at 20 and 09-0D alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack_keys(keys: np.ndarray, cut: bool) -> bytes:
    """Sorted keys as their distances."""
    if cut:
        keys = keys >> CUT
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(steps) > 1 else 1
    body = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + body.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width, first = data[0], int.from_bytes(data[1:9], "little")
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    steps = steps.view("<u8").ravel()
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; larger ones follow as they are."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


class Block:
    """The n-grams of some documents."""

    def __init__(self, texts: list[str], train: np.ndarray, order: int):
        import xxhash

        words: list[bytes] = []
        lengths = []
        for text in texts:
            some = words_of(text)
            lengths.append(len(some) + 1)
            words += some
            words.append(b"")  # stands for the end
        digest = xxhash.xxh3_64_intdigest
        hashes = {word: digest(word) for word in dict.fromkeys(words)}
        hashes[b""] = int(END)
        tokens = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        del words
        self.lengths = np.array(lengths, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.place = np.arange(len(tokens)) - np.repeat(self.begins, self.lengths)
        training = np.repeat(np.asarray(train, bool), self.lengths)
        self.keys, self.at, self.counts = [], [], []
        grams = tokens
        for k in range(order):
            if k:  # n-grams that end at each token, from the second on of their text
                grams = mixed(np.concatenate([grams[:1], grams[:-1]]) * MIX[0] + mixed(tokens))
            here = np.flatnonzero(self.place >= k)
            # longer keys are cut before they are compared, as on their way
            seen = grams[here] if k == 0 else grams[here] >> CUT << CUT
            keys, back = np.unique(seen, return_inverse=True)
            at = np.full(len(tokens), -1)
            at[here] = back
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(back[training[here]], minlength=len(keys)))

    def requests(self, buckets: int) -> dict[str, list]:
        out = {"bucket": [], "order": [], "keys": [], "counts": []}
        for k, (keys, counts) in enumerate(zip(self.keys, self.counts, strict=True)):
            to = bucket_of(keys, buckets)
            ends = np.flatnonzero(np.diff(to)) + 1
            for a, b in zip([0, *ends], [*ends, len(keys)], strict=True):
                if b > a:
                    out["bucket"].append(int(to[a]))
                    out["order"].append(k)
                    out["keys"].append(pack_keys(keys[a:b], k > 0))
                    out["counts"].append(pack_counts(counts[a:b]))
        return out


def add_up(keys: list[bytes], counts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Own counts of each sender, sums for its keys, and the sums of distinct keys."""
    parts = [unpack_keys(k) for k in keys]
    own = [unpack_counts(c, len(p)) for c, p in zip(counts, parts, strict=True)]
    _, back = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.bincount(back, np.concatenate(own)).astype(np.int64)
    ends = np.cumsum([len(p) for p in parts])
    return own, np.split(sums[back], ends[:-1]), sums


def walk(block: Block, counts: list[np.ndarray], tokens: int, types: int, prior: float):
    """Per document: tokens, known ones, base score and score.

    The state before a token is the longest context with a count; it depends on the
    tokens before alone, so all positions of the block are followed at once. From the
    state, failure arcs are taken until there is an arc for the token.
    """
    own = [np.where(at >= 0, c[at], 0) for at, c in zip(block.at, counts, strict=True)]
    base = np.log10((own[0] + 1.0) / (tokens + types + 1.0))
    arc, score = 10.0**base, base
    for k in range(1, len(own)):
        context = np.concatenate([[0], own[k - 1][:-1]])  # times the k tokens before were seen
        state = (block.place >= k) & (context > 0)
        fail = np.log10(prior / (context + prior))
        lower = arc
        arc = np.where(state, (own[k] + prior * lower) / (context + prior), lower)
        score = np.where(
            state, np.where(own[k] > 0, np.log10(np.maximum(arc, 1e-300)), fail + score), score
        )
    total = lambda x: np.add.reduceat(x, block.begins)
    return block.lengths, total((own[0] > 0).astype(np.int64)), total(base), total(score)


def corpus_size(rows: DataFrame) -> tuple[int, int, int]:
    """All tokens, training tokens, and distinct training tokens."""
    buckets = shuffle_width(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, train = batch.column("text").to_pylist(), batch.column("train").to_pylist()
            words, every = set(), 0
            learned = 0
            for text, yes in zip(texts, train, strict=True):
                found = words_of(text)
                every += len(found) + 1
                if yes:
                    words.update(found)
                    learned += len(found) + 1
            import xxhash

            keys = [xxhash.xxh3_64_intdigest(w) for w in words] + [int(END)] * (learned > 0)
            keys = np.unique(np.array(keys, np.uint64))
            to = bucket_of(keys, buckets)
            ends = np.flatnonzero(np.diff(to)) + 1
            cuts = list(zip([0, *ends], [*ends, len(keys)], strict=True)) if len(keys) else [(0, 0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(to[a]) if b > a else 0 for a, b in cuts], pa.int32()),
                    pa.array([pack_keys(keys[a:b], False) if b > a else b"" for a, b in cuts], pa.binary()),
                    pa.array([every] + [0] * (len(cuts) - 1), pa.int64()),
                    pa.array([learned] + [0] * (len(cuts) - 1), pa.int64()),
                ],
                names=["bucket", "keys", "every", "learned"],
            )

    def distinct(table: pa.Table) -> pa.Table:
        parts = [unpack_keys(k) for k in table.column("keys").to_pylist() if k]
        types = len(np.unique(np.concatenate(parts))) if parts else 0
        both = [sum(table.column(c).to_pylist()) for c in ("every", "learned")]
        return pa.table({"every": [both[0]], "learned": [both[1]], "types": [types]})

    found = (
        rows.mapInArrow(send, "bucket int, keys binary, every long, learned long")
        .groupBy("bucket").applyInArrow(distinct, "every long, learned long, types long")
        .agg(F.sum("every"), F.sum("learned"), F.sum("types")).first()
    )
    return tuple(int(x or 0) for x in found)


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    prior: float = PRIOR,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train`` says, over the columns of ``docs``, which texts are learned from. Null
    and empty texts have their end alone. Repeated rows and null ids count row by row;
    other columns are not read. An empty table gives no rows. ``base_score`` is that
    of the state without a context.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), train.alias("train")
    )
    every, tokens, types = corpus_size(rows.select("text", "train"))
    blocks = max(1, -(-every // block_tokens))
    buckets = 2 * blocks
    width = max(shuffle_width(spark), blocks)
    dealt = rows.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    ).repartition(width, "block")

    def build(table: pa.Table) -> Block:
        yes = np.array(table.column("train").to_pylist(), bool)
        return Block(table.column("text").to_pylist(), yes, order)

    def send(table: pa.Table) -> pa.Table:
        out = build(table).requests(buckets)
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(out["bucket"], pa.int32()),
                "order": pa.array(out["order"], pa.int32()),
                "block": pa.array([block] * len(out["bucket"]), pa.int64()),
                "keys": pa.array(out["keys"], pa.binary()),
                "counts": pa.array(out["counts"], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        own, sums, _ = add_up(table.column("keys").to_pylist(), table.column("counts").to_pylist())
        more = [pack_counts(s - o) for s, o in zip(sums, own, strict=True)]
        return table.drop_columns(["keys", "counts"]).append_column(
            "more", pa.array(more, pa.binary())
        ).append_column("n", pa.array([len(o) for o in own], pa.int32()))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = build(table)
        counts = []
        got = answers.sort_by([("order", "ascending"), ("bucket", "ascending")])
        orders = np.array(got.column("order").to_pylist())
        more, sizes = got.column("more").to_pylist(), got.column("n").to_pylist()
        for k in range(order):
            parts = [unpack_counts(more[i], sizes[i]) for i in np.flatnonzero(orders == k)]
            counts.append(block.counts[k] + (np.concatenate(parts) if parts else 0))
        n, known, base, total = walk(block, counts, tokens, types, prior)
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "train": table.column("train"),
                "n_tokens": n, "n_known": known, "base_score": base, "score": total,
            }
        )

    fields = "bucket int, order int, block long, keys binary, counts binary"
    answers = (
        dealt.groupBy("block").applyInArrow(send, fields)
        .groupBy("bucket", "order")
        .applyInArrow(answer, "bucket int, order int, block long, more binary, n int")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        dealt.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(
            score,
            f"doc_id {kind}, train boolean, n_tokens long, n_known long, "
            "base_score double, score double",
        )
        .select(
            F.col("doc_id").alias(id_col), "train", "n_tokens", "n_known",
            F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )
