"""Every query with SQL against DuckDB on the smallest tables, and the rest for a stable schema."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext import catalog, service_queries  # noqa: F401
from loomtext.plans import passes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    a = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    b = sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_the_rest_gives_the_same_rows_twice(spark, name):
    """Nothing that differs from run to run, such as a duration, is in a result."""
    first, second = (sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session started elsewhere, with nothing on PYTHONPATH: the queries bring the package along."""
    root = str(Path(entry.__file__).resolve().parent)
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print("rows", entry.queries()["chunk_overlap"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]


def test_native_passes_leave_zones_alone(spark):
    text = "See [1] and (Smith et al., 2010) but `[2]` and $a[3]$ stay. aBig (cid:4)\nword , here.. end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, content string")
    rows = {r.doc_id: r for r in passes.run(docs, passes.Pipeline(("citation_removal", "ocr_cleanup"))).collect()}
    new = rows[1].content
    assert "`[2]`" in new and "$a[3]$" in new and "[1]" not in new and "Smith" not in new
    assert "(cid" not in new and "word, here. end" in new
    assert rows[2].content == rows[3].content == "" and len(rows[1].history) == 2


def test_a_failing_pass_keeps_the_text(spark):
    def fail(text, p, kept):
        raise RuntimeError("no")

    passes.register(passes.Pass("failing", "", 1, {}, edit=fail), force=True)
    try:
        docs = spark.createDataFrame([(1, "text")], "doc_id long, content string")
        row = passes.run(docs, passes.Pipeline(("failing",))).first()
        assert row.content == "text" and row.history[0].error == "no"
    finally:
        passes.unregister("failing")
