import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.data import awkward, nothing
from trackframe.llm.tokenfiles import (
    PieceTokens, joined_crc, read_documents, read_manifest, read_pieces, read_range, write_tokens,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def split(tokens, texts):
    ids, stops = tokens.encode(pa.array(texts, pa.string()), 2)
    return [x.tolist() for x in np.split(ids, stops[:-1])]


CASES = [
    "", " ", "  ", "a", " a", "a ", "  a", "a  b", "a \n b", "a\n b", "a\n\n  b  \n", "don 't don't",
    "x  y", "x y z", "a  b", "a​ b", "a\x1c b\x1c c", "!\x1c !", "᠎ x",
    "tab\t tab \t", "日本語 テキスト", "é" * 50 + " \r\n é", "hello <|endoftext|> world",
    "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> ", " <|endof text|>", "12 345  6'll 's",
    "﻿a b", "a\u0085 b", "a\x0b\x0c b", "🙂 🙂🙂  🙂", "x" * 3000 + " " * 30 + "y",
]


def test_pieces_equal_whole_texts(library):
    assert split(PieceTokens(PATH), CASES) == [ids_of(library, t) for t in CASES]
    for text in CASES:
        assert split(PieceTokens(PATH), [text]) == [ids_of(library, text)]


def test_random_mixtures_of_borders(library):
    rng = random.Random(7)
    signs = ["a", "Bé", " ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "'s", "!", "9", "日",
             "<|endoftext|>", "​", "　", "Ж", "α", "カ", "한", "漢", "\u00ad", "\u0301", "ɏ", "'ll", "¿"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert split(PieceTokens(PATH), texts) == [ids_of(library, t) for t in texts]


def test_other_kinds_of_tokenizers_get_whole_texts():
    library = Tokenizer.from_file(WORDS)
    tokens = PieceTokens(WORDS)
    assert not tokens.cuts
    assert split(tokens, CASES) == [ids_of(library, t) for t in CASES]


def test_crc_of_joined_parts():
    rng = random.Random(1)
    data = [rng.randbytes(rng.randint(0, 3000)) for _ in range(20)]
    assert joined_crc([(zlib.crc32(d), len(d)) for d in data]) == zlib.crc32(b"".join(data))
    assert joined_crc([]) == 0


@pytest.mark.parametrize("piece,parts", [(8192, 5), (7, 3), (100, 1)])
def test_files_hold_what_the_library_gives(spark, library, tmp_path, piece, parts):
    docs = awkward(spark)
    path = f"{tmp_path}/files"
    write_tokens(docs, path, PATH, piece=piece, parts=parts)
    want = {}
    for row in docs.select("doc_id", "text").collect():
        ids = ids_of(library, row["text"])
        key = (row["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4")))
        want[key] = want.get(key, 0) + 1
    got, ends = {}, []
    rows = read_documents(spark, path).collect()
    for row in rows:
        key = (row["doc_id"], row["n_tokens"], row["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        ends.append((row["start"], row["start"] + row["n_tokens"], row["doc_id"]))
    assert got == want
    ends.sort()
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    order = [d for _, _, d in ends]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    pieces = read_pieces(spark, path)
    assert pieces.agg(F.max("n")).first()[0] <= piece
    stream = [i for r in pieces.orderBy("start").collect() for i in r["ids"]]
    assert len(stream) == ends[-1][1]
    rng = random.Random(3)
    for a, b in [(0, 1), (0, len(stream)), (5, 5), (len(stream) - 1, len(stream) + 50)] + [
        sorted(rng.sample(range(len(stream)), 2)) for _ in range(4)
    ]:
        found = sorted((r["start"], r["ids"]) for r in read_range(spark, path, a, b).collect())
        assert [i for _, ids in found for i in ids] == stream[a:b]
        assert all(s >= a for s, _ in found)


def test_empty_table(spark, tmp_path):
    write_tokens(nothing(spark), f"{tmp_path}/none", PATH)
    assert read_documents(spark, f"{tmp_path}/none").count() == 0
    assert read_range(spark, f"{tmp_path}/none", 0, 10).count() == 0


def test_encodings_indexes_and_columns_that_are_read(spark, tmp_path):
    path = f"{tmp_path}/files"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_tokens(docs, path, PATH, parts=2)
    files = sorted((tmp_path / "files" / "tokens").glob("*.parquet"))
    assert len(files) == read_manifest(spark, path).count() == 2
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert columns["ids.list.element"].dictionary_page_offset is not None
        for name in ("offset", "ahead", "doc_tokens", "doc_id"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings
            assert columns[name].has_column_index and columns[name].has_offset_index
    plan = read_pieces(spark, path).select("doc_id", "doc_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    some = read_pieces(spark, path).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in some


def test_a_range_reads_few_pages(spark, tmp_path):
    path = f"{tmp_path}/files"
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text"))
    write_tokens(docs, path, PATH, parts=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = read_range(spark, path, 400_000, 400_100)
        assert sum(len(r["ids"]) for r in found.collect()) == 100
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = [
        scan.apply(i).metrics().apply("numOutputRows").value()
        for i in range(scan.size()) if "offset" in scan.apply(i).output().toString()
    ]
    assert read and max(read) <= 4_000
