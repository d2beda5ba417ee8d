"""Language by a convolutional network over bytes.

Windows of fixed length are embedded byte by byte, filters of several widths slide
over them from every byte on, the maximum of each filter goes to a softmax. Windows
overlap by the widest filter less one byte, so that no run of bytes is cut by a border;
places behind the end of a window are zeros. All of it is trained in numpy. A text is
the mean of the log-probabilities of its windows, weighted by the bytes they add.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import in_fold, runs_of, small_batches, text_of, unused
from trackframe.llm.sampling import class_sample

LENGTH = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
DIM = 8
#: Bytes from one window to the next.
STEP = LENGTH - max(WIDTHS) + 1
#: Windows that are worked out together, and characters of texts.
BATCH, TEXTS = 512, 1_000_000
UNKNOWN = "und"


def windows_of(data: bytes) -> np.ndarray:
    """(windows, LENGTH) bytes; the last window is filled with zeros."""
    count = max(1, -(-(len(data) - LENGTH + STEP) // STEP))
    out = np.zeros((count - 1) * STEP + LENGTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(out, LENGTH)[::STEP]


class ByteNet:
    """Embedding, filters (narrow ones padded with zeros to the widest), softmax."""

    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        widest, many = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.mask = np.zeros((widest, DIM, many), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(widest * DIM, many)
        self.kernel = rng.normal(0, 0.2, self.mask.shape).astype(np.float32) * self.mask
        self.shift = np.zeros(many, np.float32)
        self.out = rng.normal(0, 0.2, (many, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest * DIM)"""
        widest = max(WIDTHS)
        values = np.zeros((len(windows), LENGTH + widest - 1, DIM), np.float32)
        values[:, :LENGTH] = self.embed[windows]
        view = np.lib.stride_tricks.as_strided(
            values, (len(windows), LENGTH, widest * DIM), values.strides
        )
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray):
        """Pooled filter values, where each maximum is, and the patches."""
        patches = self.patches(windows)
        n, places, size = patches.shape
        raw = (patches.reshape(-1, size) @ self.kernel).reshape(n, places, -1)
        return raw, patches

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), BATCH):
            raw, _ = self.pooled(windows[at : at + BATCH])
            hidden = np.maximum(raw.max(axis=1) + self.shift, 0)
            logits = hidden @ self.out + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(parts)

    def train(self, windows: np.ndarray, targets: np.ndarray, epochs: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "kernel", "shift", "out", "bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        widest = max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                x, y = windows[pick], targets[pick]
                raw, patches = self.pooled(x)
                place = raw.argmax(axis=1)
                rows = np.arange(len(x))[:, None]
                best = raw[rows, place, np.arange(raw.shape[2])[None, :]] + self.shift
                hidden = np.maximum(best, 0)
                logits = hidden @ self.out + self.bias
                logits -= logits.max(axis=1, keepdims=True)
                probs = np.exp(logits)
                probs /= probs.sum(axis=1, keepdims=True)
                probs[np.arange(len(x)), y] -= 1
                probs /= len(x)
                back = (probs @ self.out.T) * (best > 0)
                chosen = patches[rows, place]  # (windows, filters, widest * DIM)
                grads = {
                    "out": hidden.T @ probs,
                    "bias": probs.sum(axis=0),
                    "shift": back.sum(axis=0),
                    "kernel": np.einsum("nfk,nf->kf", chosen, back) * self.mask,
                }
                to_bytes = (back[:, :, None] * self.kernel.T[None]).reshape(-1, DIM)
                at_byte = place[:, :, None] + np.arange(widest)[None, None, :]
                behind = np.full((len(x), widest - 1), 256)  # has no embedding
                which = np.hstack([x, behind])[rows[:, :, None], at_byte].reshape(-1)
                grads["embed"] = np.stack(
                    [np.bincount(which, to_bytes[:, d], 257)[:256] for d in range(DIM)], axis=1
                )
                step += 1
                for k in names:  # Adam
                    g = grads[k].astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, k, getattr(self, k) - rate * first[k] / (np.sqrt(second[k]) + 1e-8))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; unknown and 0 without a letter."""
        data = [t.encode("utf-8", "replace") for t in texts]
        groups = [windows_of(d) for d in data]
        counts = [len(g) for g in groups]
        logs = self.log_probs(np.concatenate(groups)) if groups else np.zeros((0, 1))
        labels, scores, at = [], [], 0
        for text, raw, count in zip(texts, data, counts, strict=True):
            if not any(map(str.isalpha, text)):
                labels.append(UNKNOWN)
                scores.append(0.0)
            else:
                weight = np.full(count, float(STEP))
                weight[-1] = len(raw) - STEP * (count - 1)
                mean = weight @ logs[at : at + count].astype(float) / weight.sum()
                probs = np.exp(mean - mean.max())
                probs /= probs.sum()
                best = int(probs.argmax())
                labels.append(self.classes[best])
                scores.append(float(probs[best]))
            at += count
        return labels, scores


def fit(pairs: list[tuple[str, str]], per_text: int = 6, epochs: int = 8) -> ByteNet | None:
    """Train on (text, language) pairs, on a few windows of each text."""
    pairs = [p for p in pairs if p[0]]
    if not pairs:
        return None
    rng = np.random.default_rng(3)
    classes = sorted({lang for _, lang in pairs})
    xs, ys = [], []
    for text, lang in pairs:
        windows = windows_of(text.encode("utf-8", "replace"))
        some = rng.permutation(len(windows))[:per_text]
        xs.append(windows[some])
        ys += [classes.index(lang)] * len(some)
    net = ByteNet(classes)
    net.train(np.concatenate(xs), np.array(ys), epochs)
    return net


def language_model(
    docs: DataFrame,
    per_class: int = 400,
    max_chars: int = 20_000,
    folds: int = 5,
    held_out: int = 0,
) -> ByteNet | None:
    """Fit on a bounded sample of each language outside the held-out fold, however many.

    Rows with a null id, text or language are not learned from, nor texts without a
    letter or longer than ``max_chars``. None if nothing is left.
    """
    usable = (
        docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~in_fold("doc_id", folds, held_out))
        .filter((F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    )
    rows = class_sample(usable.select("doc_id", F.col("lang").alias("label"), "text"), per_class)
    found = sorted((str(r["doc_id"]), r["text"], r["label"]) for r in rows.collect())
    return fit([(text, lang) for _, text, lang in found])


def predict_column(text: Column, model: ByteNet | None) -> Column:
    """Struct of ``lang_pred`` and ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        labels, scores = [], []
        values = texts.tolist()
        for run in runs_of([len(t) for t in values], TEXTS):
            some = values[run]
            got = model.predict(some) if model else ([UNKNOWN] * len(some), [0.0] * len(some))
            labels += got[0]
            scores += got[1]
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    return predict(text)


def predict_language(docs: DataFrame, model: ByteNet | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; every window of a text counts.

    Texts that are null, empty or without a letter get ``und`` and 0, as does every
    text without a model. Rows are judged one by one; other columns are kept, but for an
    older ``lang_pred`` or ``score``.
    """
    small_batches(docs.sparkSession)
    both = unused(docs, "judged_")
    judged = docs.withColumn(both, predict_column(text_of(text_col), model))
    return judged.withColumns(
        {"lang_pred": F.col(f"{both}.lang_pred"), "score": F.col(f"{both}.score")}
    ).drop(both)
