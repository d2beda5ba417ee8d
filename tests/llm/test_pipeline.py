import inspect
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.data import awkward, nothing
from trackframe.llm import quality, toxicity
from trackframe.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order_and_keep_the_columns(spark):
    docs = read(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == docs.columns and out.schema == docs.schema
        path = corpus_pipeline.stored(out, name)
        assert 0 < path.count() <= before
        docs, before = path, path.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality", "exact_dedup", "near_dedup", "packing"
    ]


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r["length"] for r in rows) == sum(
        n for n in {r["doc_id"]: r["doc_tokens"] for r in rows}.values()
    )


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def plain_kept(spark, docs):
    """(stage, ids that stay) in plain Python: scores, equal texts, all pairs of bags."""
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels = read(spark, SF, "labels")
    model = toxicity.toxicity_model(docs, labels)
    rows = {i: t for i, t in rows.items() if model.scores([t])[0] < corpus_pipeline.TOXIC}
    yield "toxicity", set(rows)
    kept = docs.filter(docs["doc_id"].isin([int(i) for i in rows]))
    model = quality.quality_model(kept, labels)
    rows = {i: t for i, t in rows.items() if model.scores([t])[0] >= corpus_pipeline.POOR}
    yield "quality", set(rows)
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: rows[i] for i in last.values()}
    yield "exact_dedup", set(rows)
    bags = {}
    for i, t in rows.items():
        words = re.findall(r"\w+", t.lower())
        size = min(5, len(words))
        bags[i] = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1) if words)
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(rows):
        for j in (k for k in sorted(rows) if k < i and bags[k] and bags[i]):
            both = (bags[i] & bags[j]).total()
            if both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = {i: t for i, t in rows.items() if find(i) == i}
    yield "near_dedup", set(rows)


def test_stages_keep_what_plain_python_keeps(spark):
    """Each stage on what the one before kept; the tokens of the last are those of the library."""
    docs = read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    sizes = [docs.count()]
    for name, want in plain_kept(spark, read(spark, SF, "documents")):
        docs = corpus_pipeline.stored(stages[name](spark, docs, SF), name)
        assert {r["doc_id"] for r in docs.collect()} == want, name
        sizes.append(len(want))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = stages["packing"](spark, docs, SF).collect()
    length = dict.fromkeys(ids, 0)
    for r in pieces:
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(part)
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(own) for i, own in ids.items()}
    assert sorted((r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(
        (r["doc_id"], r["start"]) for r in pieces
    )
