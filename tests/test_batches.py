"""Batches of documents that go to Python workers."""

from pyspark.sql import functions as F

from loomtext.plans import passes


def test_batches_are_bounded(spark):
    """No batch of more than some hundred documents goes to a Python worker, and one of long texts is worked on in parts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.range(1000).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("concat('a $x$ ', repeat('b', cast(id as int) % 50 * 100))").alias("content"))
        done = passes.run(docs, passes.Pipeline(("equation_extraction", "ocr_cleanup", "equation_restoration")))
        assert int(spark.conf.get(name)) <= 256
        rows = done.collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    for r in rows:
        assert r.content == "a $x$ " + "b" * (r.doc_id % 50 * 100) if r.doc_id % 50 else r.content == "a $x$ "
        assert [h.pass_name for h in r.history] == ["equation_extraction", "ocr_cleanup", "equation_restoration"]
    parts = list(passes.pieces([5, 5, 20, 1, 1, 0, 9], 10))
    assert parts == [(0, 2), (2, 1), (3, 3), (6, 1)] and not list(passes.pieces([], 10))
