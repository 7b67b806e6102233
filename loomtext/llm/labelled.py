"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, parts: int, part: int):
    """True for ids whose crc32, as text, leaves the given remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def sample_ids(labels: DataFrame, label: str, per_class: int, parts: int, part: int, id_col: str = "doc_id") -> DataFrame:
    """labels -> at most 2 * per_class rows (doc_id, y) outside the held-out part, the same at every run.

    Of each class those with the least hash of the id are taken. Rows without an id or a label are no labels;
    an id with several labels has the greatest.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", parts, part))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    found = [(r.doc_id, r.y) for y in (0, 1) for r in rows.filter(F.col("y") == y).orderBy(*order).limit(per_class).collect()]
    return labels.sparkSession.createDataFrame(found, "doc_id long, y int")


def sample_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts of sampled ids. The ids are broadcast: their number is bounded by sample_ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("y", "text")
