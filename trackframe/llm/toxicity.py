"""Toxicity from bags of subwords.

Each word is the mean of the vectors of its character n-grams, which live in hashed
rows of one table; a window of words is the mean of its words; a linear softmax
scores it. A run of more than LONGEST_WORD characters without white space is taken apart
at its signs, and what is still longer is cut into short overlapping pieces, so that an
insult in text without spaces stands as much by itself as one between spaces.
Table and softmax are trained together in numpy. An unseen misspelling
shares n-grams with the words it stands for. A text is as toxic as its worst window,
so a single insult in a long text counts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import in_fold, release, runs_of, small_batches, text_of
from trackframe.llm.sampling import labelled_texts

BUCKETS = 1 << 16
SHORTEST, LONGEST = 3, 5
#: Longer runs are taken apart, into pieces of this length if they have no signs.
LONGEST_WORD, PIECE = 24, 8
WINDOW = 3
DIM = 8
HIDDEN = 0.25
CACHE_ENTRIES = 200_000
#: Characters of texts that are scored together.
STEP = 250_000
WORD = re.compile(r"\S+")
PART = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs without white space; longer ones as their parts, or as overlapping pieces."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    return [piece for word in words for piece in _pieces(word)]


def _pieces(word: str) -> list[str]:
    if len(word) <= LONGEST_WORD:
        return [word]
    parts = PART.findall(word)
    if 3 * len(parts) > sum(map(len, parts)):  # signs between single letters, or nothing but signs
        parts = ["".join(parts) or word]
    step = PIECE - LONGEST + 1
    return [
        part[at : at + PIECE] if len(part) > LONGEST_WORD else part
        for part in parts
        for at in (range(0, len(part) - LONGEST + 1, step) if len(part) > LONGEST_WORD else [0])
    ]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of each word and of the word itself, and their counts.

    Words have a mark at either end and at most LONGEST_WORD characters.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64) + np.uint64(1)
    left = np.repeat(begins + sizes, sizes) - np.arange(len(codes))  # to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    mix, prime = np.uint64(0x9E3779B97F4A7C15), np.uint64(1_000_003)
    rows, owners = [], []
    rolling = codes
    for n in range(2, LONGEST + 1):
        rolling = rolling[:-1] * prime + codes[n - 1 :] if len(codes) >= n else rolling[:0]
        if n >= SHORTEST:
            inside = np.flatnonzero(left[: len(rolling)] >= n)
            rows.append(rolling[inside] + np.uint64(n))
            owners.append(owner[inside])
    powers = np.cumprod(np.full(LONGEST_WORD + 2, 31, np.uint64))
    rows.append(np.add.reduceat(codes * powers[sizes[owner] - left], begins))
    owners.append(np.arange(len(words)))
    owners_flat = np.concatenate(owners)
    order = np.argsort(owners_flat, kind="stable")
    hashed = ((np.concatenate(rows) * mix) >> np.uint64(40)) % np.uint64(BUCKETS)
    return hashed[order].astype(np.int32), np.bincount(owners_flat, minlength=len(words))


def window_means(values: np.ndarray) -> np.ndarray:
    """Means over all runs of WINDOW values; over all of them if they are fewer."""
    if len(values) <= WINDOW:
        return np.array([values.mean()]) if len(values) else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


def word_vectors(table, flat, starts, sizes, step: int = 10_000) -> np.ndarray:
    """The mean table row of each word, some words at a time."""
    out = np.empty((len(sizes), table.shape[1]), table.dtype)
    for at in range(0, len(sizes), step):
        some = slice(at, at + step)
        first, last = starts[at], starts[some][-1] + sizes[some][-1]
        sums = np.add.reduceat(table[flat[first:last]], starts[some] - first, axis=0)
        out[some] = sums / sizes[some, None]
    return out


class SubwordModel:
    """One number per table row (its vector times the softmax's direction), and a bias."""

    def __init__(self, rows: np.ndarray, bias: float):
        self.rows, self.bias = rows, bias
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return {"rows": self.rows, "bias": self.bias, "cache": {}}

    def learn_words(self, words: set[str]) -> None:
        """Fill the cache with the values of words that it lacks."""
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            new = list(words)
        flat, sizes = subwords(new)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        means = np.add.reduceat(self.rows[flat], starts) / sizes
        self.cache.update(zip(new, means.tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        bags = [words_of(t) for t in texts]
        self.learn_words(set().union(*bags))
        value = self.cache.__getitem__
        out = []
        for bag in bags:
            means = window_means(np.fromiter(map(value, bag), float, len(bag)))
            worst = means.max() + self.bias if len(bag) else -np.inf
            out.append(float(1 / (1 + np.exp(-np.clip(worst, -700, 30)))) if len(bag) else 0.0)
        return out


def fit(pairs: list[tuple[str, int]], epochs: int = 40, seed: int = 7) -> SubwordModel | None:
    """Train on (text, label) pairs; None without both labels."""
    if len({label for _, label in pairs}) < 2:
        return None
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    bags = [np.array([index.setdefault(w, len(index)) for w in words_of(t)]) for t, _ in pairs]
    keep = [i for i, bag in enumerate(bags) if len(bag)]
    bags, labels = [bags[i] for i in keep], np.array([pairs[i][1] for i in keep], float)
    if not bags:
        return None
    flat, sizes = subwords(list(index))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat_words = np.concatenate(bags)
    lengths = np.array([len(b) for b in bags])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # all windows of all texts, as first word and length
    spans = np.maximum(lengths - WINDOW + 1, 1)
    first = np.repeat(begins - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans)
    first = first + np.arange(spans.sum())
    width = np.repeat(np.minimum(lengths, WINDOW), spans)
    owner_start = np.concatenate([[0], np.cumsum(spans)[:-1]])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    # two classes: the softmax is the logistic of one direction
    out, bias = rng.normal(0, 0.5, DIM).astype(np.float32), 0.0
    past_table, past_out, past_bias = np.full((BUCKETS, 1), 1e-8, np.float32), 1e-8, 1e-8
    toxic = np.repeat(labels == 1, spans)
    balance = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    for epoch in range(epochs):
        vectors = word_vectors(table, flat, starts, sizes)
        sums = np.concatenate([[0.0], np.cumsum((vectors @ out)[flat_words])])
        logits = (sums[first + width] - sums[first]) / width + bias
        # a text must not rest on one telling word: hide some words of toxic texts
        if epoch % 2:
            hidden = rng.random(len(index)) < HIDDEN
            hide = np.concatenate([[0], np.cumsum(hidden[flat_words])])
            logits = np.where(toxic & (hide[first + width] > hide[first]), logits - 40, logits)
        # softly at first: early on the worst window is not yet known
        heat = min(1 + epoch / 4, 12)
        top = np.maximum.reduceat(logits, owner_start)
        weight = np.exp(np.clip(heat * (logits - np.repeat(top, spans)), -50, 0))
        weight /= np.repeat(np.add.reduceat(weight, owner_start), spans)
        level = np.add.reduceat(weight * logits, owner_start)
        error = (1 / (1 + np.exp(-level)) - labels) * balance
        pull = weight * np.repeat(error, spans) / width
        chosen = np.abs(pull) > 1e-9
        grad_words = np.zeros(len(index))
        for k in range(WINDOW):
            use = chosen & (width > k)
            np.add.at(grad_words, flat_words[first[use] + k], pull[use])
        touched = np.flatnonzero(grad_words)
        grad_out = grad_words[touched] @ vectors[touched]
        per_row = np.bincount(
            flat, weights=np.repeat(grad_words / sizes, sizes), minlength=BUCKETS
        )
        grad_table = (per_row[:, None] * out[None, :]).astype(np.float32)
        past_table += (grad_table**2).mean(axis=1, keepdims=True)
        past_out += float((grad_out**2).mean())
        past_bias += float(error.sum() ** 2)
        table -= 0.5 * grad_table / np.sqrt(past_table)
        out = (out - 0.2 * grad_out / np.sqrt(past_out)).astype(np.float32)
        bias -= 0.2 * float(error.sum()) / np.sqrt(past_bias)
    return SubwordModel((table @ out).astype(np.float32), float(bias))


def score_column(text: Column, model: SubwordModel | None) -> Column:
    """Scores of texts; 0 without a model."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        if model is None:
            return pd.Series(np.zeros(len(values)))
        parts = (model.scores(values[run]) for run in runs_of([len(t) for t in values], STEP))
        found = pd.Series([x for part in parts for x in part], dtype=float)
        release()
        return found

    return score.asNondeterministic()(text)


def toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1200,
    max_chars: int = 20_000,
    folds: int = 3,
    held_out: int = 1,
) -> SubwordModel | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    Null ids, labels and texts are not learned from; of several labels of an id the
    largest counts. None if there is no row of either label.
    """
    small_batches(docs.sparkSession)
    allowed = ~in_fold("doc_id", folds, held_out)
    return fit(labelled_texts(docs, labels, "toxic", allowed, per_class, max_chars))


def score_toxicity(docs: DataFrame, model: SubwordModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a ``score``; whole texts count.

    Null and empty texts score 0, and so does every text without a model. Rows are
    scored one by one, all other columns are kept but for an older ``score``.
    """
    return docs.withColumn("score", score_column(text_of(text_col), model))
