import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest

from tests.llm.data import awkward, nothing
from trackframe.llm import divergence
from trackframe.llm.common import text_of
from trackframe.llm.divergence import _shares, run_columns, share, source_divergence, vocabulary

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, least, top):
    """The definition, term by term, for rows of (lang, source, text)."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    found = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = {s: g for (own, s), g in groups.items() if own == lang}
        whole = sum(sources.values(), Counter())

        def shares(counts):
            n = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // n for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = shares(whole)
        p = {s: shares(g) for s, g in sources.items()}
        for s, g in sources.items():
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if g[t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                for rank, (value, item) in enumerate(values[:most], 1):
                    found.add((lang, s, part, item, value, rank))
    return found


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def corpus(spark, seed=5, sources=7, docs=200):
    rng = Random(seed)
    words = [rng.choice("abéÀZ日") + rng.choice("bcxY-0'") + rng.choice("qw") for _ in range(80)]
    rows = [
        (i, " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(rng.randint(0, 60))),
         rng.choice(["en", "en", "de", None]), f"s{int(sources * rng.random() ** 2)}")
        for i in range(docs)
    ]
    rows += [(900, "", "en", "silent"), (901, None, "xx", "alone"), (902, "rare words", "yy", "a"),
             (903, "other words", "yy", "b"), (904, None, "yy", None)]
    return awkward(spark, rows)


@pytest.mark.parametrize("least,tile,block", [(10, 64, 2048), (2, 2, 7), (1, 3, 20)])
def test_equals_the_definition(spark, least, tile, block):
    docs = corpus(spark)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    found = source_divergence(docs, least=least, tile=tile, block=block)
    assert rows_of(found) == by_hand(rows, least, 10)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least in (1, 2, 10):
        assert rows_of(source_divergence(docs, least=least)) == by_hand(rows, least, 10)


def test_empty_table(spark):
    assert source_divergence(nothing(spark)).count() == 0


def test_equal_counts_are_one_run(spark):
    """Terms that the sources hold equally often stand together, however they are named."""
    rows = [(i, " ".join(f"{chr(97 + k)}{'xy'[k % 2] * (k + 1)}" for k in range(20)) + " zz zz", "en", s)
            for i, s in enumerate("ab" * 10)]
    docs = awkward(spark, rows)
    texts = docs.select("lang", "source", text_of().alias("text"))
    found = run_columns(vocabulary(texts)).collect()
    assert {r["length"] for r in found} == {21}
    assert all(len(r["ends"]) == 2 and sorted(r["counts"]) == [10, 20] for r in found)


def test_long_division_is_exact_for_any_count(spark):
    rng = Random(2)
    cases = [(rng.randint(0, n), n, rng.randint(1, 10**9))
             for n in (rng.choice([1, 50, 10**9, 10**13, 10**15]) for _ in range(300))]
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    assert [int(_shares(np.array([c]), n, v)[0]) for c, n, v in cases] == want
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, c long, n long, v long")
    got = table.select("i", share(table["c"], table["n"], table["v"]).alias("p")).orderBy("i")
    assert [r["p"] for r in got.collect()] == want


def test_terms_of_long_texts_and_small_holdings(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "SLICE", 11)
    monkeypatch.setattr(divergence, "HELD", 3)
    texts = ["Word wörd wordword " * 30, "É" * 50 + " a-b_c", "", "AbC9abc"]
    batch = pa.RecordBatch.from_pydict({
        "lang": ["en"] * 4, "source": ["a", "a", "b", "b"], "text": [t.encode() for t in texts]})
    n, docs = Counter(), Counter()
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            n[r["source"], r["term"].decode()] += r["n"]
            docs[r["source"], r["term"].decode()] += r["docs"]
    want = Counter((s, t) for s, x in zip("aabb", texts) for t in TERM.findall(x.translate(LOWER)))
    assert n == want
    assert docs == Counter((s, t) for s, x in zip("aabb", texts) for t in set(TERM.findall(x.translate(LOWER))))


