"""Small tables with the awkward cases every operator has to bear."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, label int, node string, block string, name string, queue int, ids string, "
    "key string, rows int, start int, kept string"
)
EXTRA = ("x", 1, "n", "b", "m", 3, "i", "k", 2, 5, "no")


def awkward(spark, rows=None):
    """Null id, null and empty text, repeats, copies, a very long text, clashing names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = sentence(30_000)
    copied = sentence(80)
    near = copied.split()
    near[40] = "other"
    default = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, "   \n\t ", "en", "a"),
        (3, copied, "en", "a"),
        (4, copied, "de", "b"),
        (4, copied, "de", "b"),
        (5, " ".join(near), "en", None),
        (6, long, "en", "a"),
        (7, "12 34 !!", "fr", "b"),
        (8, "kurz", None, "b"),
        (None, copied, "en", "a"),
        (None, sentence(50), "en", "c"),
        (9, sentence(400), "fr", "a"),
        (10, "x" * 200_000, "en", "a"),
    ]
    rows = default if rows is None else rows
    return spark.createDataFrame(
        [(i, t, g, s, len(t or ""), *EXTRA) for i, t, g, s in rows], SCHEMA
    )


def nothing(spark):
    return awkward(spark, [])


def texts_of(df):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in df.collect()]
