"""Labelled rows for the classifiers: which rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, text, y, order) of at most ``most`` labelled rows that are not held out, however many rows an id has.

    ``held_out`` is a condition on doc_id. Of more rows, those with the smallest hash of their id are
    taken: a bounded sample whatever the corpus size, the same in every run. Labels other than 0 and 1,
    null labels and ids are not used; repeated labels of an id count as 1 if one of them is 1. The
    sample is small by construction, so it is broadcast to the documents instead of shuffling them.
    """
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
             .where(~held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
             .withColumn("order", F.xxhash64("doc_id", F.lit(11))))
    sample = known.orderBy("order", "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.orderBy("order", "doc_id", F.xxhash64("text")).limit(most)
