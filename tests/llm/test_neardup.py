from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import awkward, nothing, texts_of
from trackframe.llm.graph import components
from trackframe.llm.neardup import bag_minhash, keep_one_of_each, mixed, near_duplicates, numbered, overlap, shingles


def brute(rows, threshold=0.8):
    """Classes as (least id, size) of each row, from all pairs."""
    sets = [numbered(*shingles(t)) for _, t, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and overlap(sets[i], sets[j]) >= threshold:
                label[find(i)] = find(j)
    members = defaultdict(list)
    for i, row in enumerate(rows):
        members[find(i)].append(row[0])
    out = Counter()
    for ids in members.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[(i, min(known) if known else None, len(ids))] += 1
    return out


def classes(df):
    return Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in df.collect())


def edited(words, rng, changes):
    words = list(words)
    for at in rng.integers(0, len(words), changes):
        words[at] = f"w{rng.integers(10**6)}"
    return " ".join(words)


def test_signatures_are_unbiased():
    elements = mixed(np.arange(1, 31, dtype=np.uint64))
    rng = np.random.default_rng(0)
    for _ in range(4):
        a, b = rng.integers(0, 12, 30), rng.integers(0, 12, 30)
        bags = [(elements[a > 0], a[a > 0]), (elements[b > 0], b[b > 0])]
        signatures = bag_minhash(bags, 6000)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((signatures[0] == signatures[1]).mean() - true) < 0.03


def test_signature_does_not_depend_on_the_batch():
    bags = [shingles("a b c d e f g " * n) for n in (1, 2, 40)]
    together = bag_minhash(bags, 64)
    for bag, row in zip(bags, together, strict=True):
        assert (bag_minhash([bag], 64)[0] == row).all()


@pytest.mark.parametrize("bands,rows", [(30, 5), (60, 1)])
def test_equals_brute_force(spark, bands, rows):
    rng = np.random.default_rng(5)
    base = [[f"w{rng.integers(2000)}" for _ in range(120)] for _ in range(6)]
    passage = [f"p{i}" for i in range(60)]
    docs, at = [], 0
    for words in base:
        for k in range(12):
            docs.append((at, edited(words, rng, k % 4), None, None))
            at += 1
    for _ in range(20):  # a passage that many share, no near copies
        docs.append((at, " ".join(passage + [f"q{rng.integers(10**6)}" for _ in range(90)]), None, None))
        at += 1
    chain = [f"c{i}" for i in range(400)]
    for k in range(12):  # each like the next one, not like the last
        docs.append((at, " ".join(chain[k * 12 : k * 12 + 260]), None, None))
        at += 1
    docs += [(at, "one two", None, None), (at + 1, "ONE, two!", None, None), (at + 2, "", None, None)]
    table = awkward(spark, docs)
    # one row a band puts nearly all into shared buckets, so torn ones are joined anew
    assert classes(near_duplicates(table, bands=bands, rows=rows)) == brute(texts_of(table))


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = near_duplicates(docs)
    assert classes(found) == brute(texts_of(docs))
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 3 stays for 3, 4, 4, 5 and the null id; texts without words stay
    assert ids == sorted(map(str, [0, 1, 2, 3, 6, 7, 8, 9, 10, None]))
    assert sum(r["kept"] for r in found.collect()) == kept.count()


def test_empty_table(spark):
    assert near_duplicates(nothing(spark)).count() == 0
    assert keep_one_of_each(nothing(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (5, 5)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["label"] for r in rows}
    assert len(got) == len(rows)
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))
    assert got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_names_and_texts_without_words(spark):
    marks = "́́ ̂"
    rows = [(1, marks, None, None), (1, marks, None, None), (2, "a b", None, None), (2, "a b", None, None)]
    docs = awkward(spark, rows).selectExpr(
        "*", "1 as row_", "2 as key_", "3 as of_id_", "4 as OF_KEY_", "5 as wordless_", "6 as __row",
        "7 as wordless",
    )
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    said = sorted(r["doc_id"] for r in near_duplicates(docs).filter("kept").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == said == [1, 1, 2]


def test_steps_are_bounded_by_size():
    import pyarrow as pa

    from trackframe.llm.common import runs_of
    from trackframe.llm.neardup import STEP, _steps

    sizes = [5, STEP, 3, 4, STEP + 1, 1, 1]
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in sizes]})
    assert [s.num_rows for s in _steps(batch, "text")] == [1, 1, 2, 1, 2]
    assert list(runs_of([], 5)) == [] and list(runs_of([9], 5)) == [slice(0, 1)]
