import base64

import public_tokenizers
import pytest
import tiktoken

from tests.llm.data import awkward, nothing, texts_of
from trackframe.llm.bpe import decode_column, encode_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encoded(docs, **options):
    found = encode_documents(docs, PATH, public_tokenizers.PATTERN, **options)
    return found.withColumn("bytes", decode_column(found["ids"], PATH, public_tokenizers.PATTERN))


@pytest.mark.parametrize("size,overlap", [(65_536, 1024), (500, 40), (64, 4)])
def test_equals_the_library_and_round_trips(spark, library, size, overlap):
    docs = awkward(spark).filter("length(coalesce(text, '')) < 200000")
    got = sorted((tuple(r["ids"]), bytes(r["bytes"])) for r in
                 encoded(docs, chunk_chars=size, overlap=overlap).collect())
    want = sorted((tuple(library.encode_ordinary(t)), t.encode()) for _, t, _ in texts_of(docs))
    assert got == want


def test_borders_inside_runs(spark, library):
    texts = ["a" + " " * 90 + "b", "don't we're " * 30, "1234567890" * 20 + " x", "\n \n" * 50,
             "é" * 70 + " 日本語 " * 20, "!!!'s" * 40, "x" * 300, "<|endoftext|>" * 9]
    docs = awkward(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: list(r["ids"]) for r in encoded(docs, chunk_chars=40, overlap=8).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert encoded(nothing(spark)).count() == 0
