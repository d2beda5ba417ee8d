import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.oracle_check import difference
from trackframe.llm import queries as Q
from trackframe.llm.common import read

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = Q.load()

COLUMNS = {
    1: "doc_id held_out score predicted",
    2: "doc_id class_id class_size kept",
    3: "doc_id held_out score predicted",
    4: "doc_id start length ids_crc32 doc_tokens sequence_id offset source",
    5: "query_id rank vec_id score",
    6: "doc_id held_out n_tokens n_known train_tokens base_score score",
    7: "page_id host path rule verdict template",
    8: "doc_id keep_id group_size kept text_sha256",
    9: "doc_id held_out lang_pred score",
    10: "doc_id n_tokens ids_sha256 decoded_sha256",
    11: "lang source part item value rank",
    12: "doc_id start n_tokens ids_crc32",
    13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, SF, QUERIES[name], ORACLES[name]) is None


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_a_row_for_each_input_row(spark, name):
    number = int(re.match(r"op(\d+)_", name)[1])
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[number].split()
    table = {5: "embeddings", 7: "pages"}.get(number, "documents")
    rows = read(spark, SF, table).count()
    if number == 5:
        rows = 20 * read(spark, SF, table).filter("vec_id % 20 = 0").count()
    if number in (11, 13):
        return
    if number == 4:
        assert found.select("doc_id").distinct().count() == rows
    else:
        assert found.count() == rows


def test_decoded_bytes_are_the_text(spark):
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in QUERIES["op10_byte_bpe"](spark, SF).collect()}
    docs = read(spark, SF, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    for row in docs.collect():
        assert decoded[row["doc_id"]] == hashlib.sha256(row["text"].encode()).hexdigest()
