import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, nothing, texts_of
from trackframe.llm.lm import CUT, pack_counts, pack_keys, score_texts, unpack_counts, unpack_keys

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER)) + ["</s>"]


def brute(rows, train, order, prior):
    """Dictionaries of n-grams, one token after the other."""
    grams = Counter()
    for text, learn in zip(rows, train, strict=True):
        if learn:
            w = words(text)
            for n in range(1, order + 1):
                grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c for g, c in grams.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in grams)
    out = []
    for text in rows:
        w = words(text)
        base = score = 0.0
        for i, word in enumerate(w):
            p = (grams[(word,)] + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(1, min(order, i + 1)):
                context = tuple(w[i - n : i])
                if not grams[context]:
                    break
                p = (grams[context + (word,)] + prior * p) / (grams[context] + prior)
            score += math.log10(p)
        out.append((len(w), sum(grams[(x,)] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("order,block_tokens", [(1, 10**6), (2, 500), (3, 500), (3, 10**6)])
def test_equals_brute_force(spark, order, block_tokens):
    docs = awkward(spark).filter("length(coalesce(text, '')) < 100000")
    train = F.coalesce(F.col("doc_id") != 4, F.lit(True))
    got = score_texts(docs, train, order=order, prior=3.0, block_tokens=block_tokens).collect()
    rows = texts_of(docs)
    want = brute([t for _, t, _ in rows], [i != 4 for i, _, _ in rows], order, 3.0)
    key = lambda x: tuple(round(float(v), 6) for v in x)
    found = sorted(
        key((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in got
    )
    np.testing.assert_allclose(found, sorted(map(key, want)), rtol=1e-6)


def test_probabilities_of_a_state_sum_to_one(spark):
    texts = ["a b", "a c", "a b a", "b a"]
    vocabulary = ["a", "b", "c", "unseen"]
    docs = awkward(spark, [(i, t, None, None) for i, t in enumerate(texts)]
                   + [(10 + i, "a " + w, None, None) for i, w in enumerate(vocabulary)]
                   + [(20, "a", None, None), (21, "", None, None)])
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") < 10).collect()}
    # p(a w end) summed over w without the end after w: use p(end) of each context instead
    grams = brute(texts + ["a"], [True] * 4 + [False], 3, 16.0)
    assert math.isclose(got[20], grams[4][4], rel_tol=1e-9)


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (unpack_keys(pack_keys(keys, False)) == keys).all()
        assert (unpack_keys(pack_keys(keys, True)) == keys >> CUT).all()
        counts = rng.integers(0, 600, n)
        assert (unpack_counts(pack_counts(counts), n) == counts).all()


def test_empty_table_and_nothing_to_learn_from(spark):
    assert score_texts(nothing(spark), F.lit(True)).count() == 0
    rows = score_texts(awkward(spark), F.lit(False)).collect()
    assert all(r["base_score"] == 0 == r["n_known"] == r["train_tokens"] for r in rows)
