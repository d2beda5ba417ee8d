"""Bounded samples of labelled texts, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Of more classes than this, each has fewer rows in the sample.
FULL_CLASSES = 64
SLOTS = 1_000_000


def class_sample(rows: DataFrame, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class of ``rows`` (doc_id, label), by hash of the id.

    No class is left out. All have at most ``FULL_CLASSES * per_class`` rows, give or
    take the chance of the hash: with more classes each has an equal part of that, but
    at least its first rows by hash. Only the counts of the classes, as many as the
    model will have outputs, come to the driver.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(SLOTS))
    classes = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(slot).alias("first")).collect()
    each = per_class * min(1.0, FULL_CLASSES / max(len(classes), 1))
    rates = rows.sparkSession.createDataFrame(
        [(r["label"], max(each * SLOTS / r["n"], r["first"] + 0.5)) for r in classes],
        StructType([StructField("label", rows.schema["label"].dataType), StructField("rate", DoubleType())]),
    )
    return rows.join(F.broadcast(rates), "label").filter(slot < F.col("rate")).drop("rate")


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, max_chars: int
) -> list[tuple[str, int]]:
    """(text, label) pairs to fit on.

    ``allowed`` says, by doc_id, which rows may be learned from. Texts longer than
    ``max_chars`` are not picked, none is cut. Null labels and ids are left out; of
    several labels of an id the largest counts, and its text is any of its rows.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("label")).filter(allowed)
    )
    ids = docs.filter(
        F.col("text").isNotNull() & (F.length("text") <= max_chars)
    ).select("doc_id")
    sample = class_sample(known.join(ids, "doc_id", "left_semi"), per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = {
        r["doc_id"]: (r["text"], int(r["label"]))
        for r in texts.filter(F.length("text") <= max_chars).collect()
    }
    return [found[k] for k in sorted(found, key=str)]
