import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.data import awkward, nothing, texts_of
from trackframe.llm.exact import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(text, []).append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            stays = i == keep and not kept
            kept |= stays
            out[(i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_equals_brute_force(spark):
    docs = awkward(spark)
    want = brute(texts_of(docs))
    for size in (16, 4096):
        assert Counter(map(tuple, exact_duplicates(docs, block_bytes=size).collect())) == want


def test_clashing_hashes_do_not_merge_blocks(spark):
    docs = awkward(spark)
    found = exact_duplicates(docs, block_bytes=64, route=lambda block: F.lit(0).cast("long"))
    assert Counter(map(tuple, found.collect())) == brute(texts_of(docs))


def test_prefixes_and_block_order_differ(spark):
    rows = [(1, "a" * 64, None, None), (2, "a" * 65, None, None), (3, "ab" * 32, None, None),
            (4, "b" * 16 + "a" * 16, None, None), (5, "a" * 16 + "b" * 16, None, None)]
    found = exact_duplicates(awkward(spark, rows), block_bytes=16).collect()
    assert all(r["group_size"] == 1 and r["kept"] for r in found)


def test_empty_table(spark):
    assert exact_duplicates(nothing(spark)).count() == 0
    assert drop_exact_duplicates(nothing(spark)).count() == 0


def test_kept_rows_have_all_columns(spark):
    docs = awkward(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({t for _, t, _ in texts_of(docs)})
    assert all(r["name"] == "m" and r["kept"] == "no" for r in rows)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_clashing_names(spark):
    docs = awkward(spark).selectExpr(
        "*", "1 as sha_", "2 as of_id_", "3 as OF_SHA_", "4 as __sha", "5 as __id", "6 as __kept_sha"
    )
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == drop_exact_duplicates(awkward(spark)).count()
