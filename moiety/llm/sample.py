"""Bounded training samples, drawn the same way at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows drawn for each class at most, and characters that a drawn row may have.
PER_CLASS, MAX_CHARS = 1000, 100_000
#: Labels that are learnt at most: the most frequent ones, of equally frequent ones the first.
MAX_CLASSES = 200


def fold(column: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("long").cast("string")) % k


def draw(labelled: DataFrame, docs: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_class`` rows a label, of MAX_CLASSES labels, chosen by a hash of doc_id.

    ``labelled`` has doc_id and label. Ids are chosen first (a limit per label that is applied
    before the shuffle), then only their texts are read.
    """
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "label").filter("doc_id IS NOT NULL AND label IS NOT NULL")
    names = [r["label"] for r in ids.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_CLASSES).collect()]
    ids = ids.filter(F.col("label").isin(names)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_class).drop("n")
    chosen = ids.collect()  # PER_CLASS rows of MAX_CLASSES labels at most
    table = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], ids.schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= max_chars)
    got = texts.join(F.broadcast(table), "doc_id").select("doc_id", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]
