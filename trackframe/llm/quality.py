"""Quality by attention over passages.

A text is a bag of passages of a fixed number of words. Each passage is encoded from
its byte classes and its repetition; gated attention, learned from document labels
alone, weighs the passages; the weighted sum is scored. Trained in numpy.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import in_fold, release, runs_of, small_batches, text_of
from trackframe.llm.sampling import labelled_texts

WORDS = 50
#: Passages whose bytes are counted together, and characters of texts scored together.
PASSAGES, STEP = 4_096, 500_000
HIDDEN = 24
GATE = 12


def _byte_classes() -> np.ndarray:
    """(256, classes): each printable sign of its own, the rest in groups."""
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out = np.zeros((256, len(signs) + 7), np.float32)
    for k, b in enumerate(signs):
        out[b, k] = 1
    groups = [range(97, 123), range(65, 91), range(48, 58), range(128, 192), range(192, 256)]
    groups += [[32], [9, 10, 11, 12, 13]]
    for k, group in enumerate(groups):
        out[list(group), len(signs) + k] = 1
    return out


CLASSES = _byte_classes()
FEATURES = CLASSES.shape[1] + 6


def encode_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has (one at least)."""
    pieces: list[bytes] = []
    counts, stats = [], []
    for text in texts:
        words = text.split(" ")
        starts = range(0, len(words), WORDS)
        counts.append(len(starts))
        for at in starts:
            some = words[at : at + WORDS]
            lower = [w.lower() for w in some]
            n = len(some)
            different = len(set(lower))
            doubled = sum(map(eq, lower, lower[1:]))
            upper = sum(map(str.isupper, some))
            piece = " ".join(some)
            pieces.append(piece.encode("utf-8", "replace"))
            stats.append(
                (n / WORDS, different / n, doubled / n, upper / n, len(piece) / n / 10,
                 piece.count("\n") / n)
            )
    shares = [_shares(pieces[at : at + PASSAGES]) for at in range(0, len(pieces), PASSAGES)]
    return (
        np.concatenate([np.concatenate(shares), np.array(stats)], axis=1).astype(np.float32),
        np.array(counts),
    )


def _shares(pieces: list[bytes]) -> np.ndarray:
    """Root shares of the byte classes of each passage."""
    sizes = np.array([len(p) for p in pieces])
    owner = np.repeat(np.arange(len(pieces)) * 256, sizes)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    seen = np.bincount(owner + flat, minlength=256 * len(pieces)).reshape(-1, 256)
    return np.sqrt((seen @ CLASSES) / np.maximum(sizes, 1)[:, None])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gate (tanh times sigmoid), scorer."""

    NAMES = ("we", "be", "v", "u", "a", "c", "b")

    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.we, self.be = draw(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.v, self.u = draw(HIDDEN, GATE), draw(HIDDEN, GATE)
        self.a, self.c = draw(GATE), draw(HIDDEN)
        self.b = np.zeros(1, np.float32)
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ self.we + self.be)
        t, s = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * s) @ self.a
        w = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        w /= np.repeat(np.add.reduceat(w, starts), counts)
        z = np.add.reduceat(h * w[:, None], starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "w": w, "z": z, "starts": starts,
                "p": _sigmoid(z @ self.c + self.b)}

    def scores(self, texts: list[str]) -> np.ndarray:
        x, counts = encode_passages(texts)
        return self.forward(x, counts)["p"].astype(float)

    def train(self, x, counts, labels, steps: int) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
        first = {k: 0.0 for k in self.NAMES}
        second = {k: 0.0 for k in self.NAMES}
        for step in range(1, steps + 1):
            f = self.forward(x, counts)
            error = ((f["p"] - labels) * balance).astype(np.float32)
            dz = np.repeat(error[:, None] * self.c[None, :], counts, axis=0)
            dw = (dz * f["h"]).sum(axis=1)
            mean = np.repeat(np.add.reduceat(dw * f["w"], f["starts"]), counts)
            de = f["w"] * (dw - mean)
            dgate = de[:, None] * self.a[None, :]
            dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
            dh = dz * f["w"][:, None] + dt @ self.v.T + ds @ self.u.T
            dx = dh * (1 - f["h"] ** 2)
            grads = {
                "we": f["x"].T @ dx + 1e-5 * self.we, "be": dx.sum(axis=0),
                "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de,
                "c": f["z"].T @ error + 1e-4 * self.c, "b": error.sum(keepdims=True),
            }
            for k in self.NAMES:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                rate = 0.02 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                change = rate * first[k] / (np.sqrt(second[k]) + 1e-8)
                setattr(self, k, (getattr(self, k) - change).astype(np.float32))


def fit(pairs: list[tuple[str, int]], steps: int = 150) -> AttentionModel | None:
    """Train on (text, label) pairs; None without both labels."""
    if len({label for _, label in pairs}) < 2:
        return None
    x, counts = encode_passages([t for t, _ in pairs])
    model = AttentionModel()
    model.train(x, counts, np.array([label for _, label in pairs], np.float32), steps)
    return model


def quality_model(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1500,
    max_chars: int = 20_000,
    folds: int = 3,
    held_out: int = 1,
) -> AttentionModel | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    Null ids, labels and texts are not learned from; of several labels of an id the
    largest counts. None if there is no row of either label.
    """
    small_batches(docs.sparkSession)
    allowed = ~in_fold("doc_id", folds, held_out)
    return fit(labelled_texts(docs, labels, "quality", allowed, per_class, max_chars))


def score_column(text: Column, model: AttentionModel | None) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        if model is None:
            return pd.Series([0.5] * len(values))
        runs = runs_of([len(t) for t in values], STEP)
        parts = [model.scores(values[run]) for run in runs]
        release()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score.asNondeterministic()(text)


def score_quality(docs: DataFrame, model: AttentionModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a ``score``; every passage of a text counts.

    A null or empty text is one passage without words and is scored as such; without
    a model every score is one half. Rows are scored one by one, all other columns
    are kept but for an older ``score``.
    """
    return docs.withColumn("score", score_column(text_of(text_col), model))
