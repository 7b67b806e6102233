"""Sinks and look-ups: Markdown files, chunk archives, reports, registries with a time to live."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

TTL_S = 7200


def write_markdown(docs: DataFrame, path: str, content: str = "content") -> None:
    """One Markdown file for each document, named by its stem, in a folder that all executors can write to.

    Spark's text sink writes a file for each partition value: one folder ``name=<stem>.md`` for each document.
    """
    named = docs.select(F.concat(T.stem(F.col("name")), F.lit(".md")).alias("name"), F.coalesce(F.col(content), F.lit("")).alias("value"))
    named.write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def orphans(files: DataFrame, now: str = "current_timestamp()", seconds: int = TTL_S) -> DataFrame:
    """(path): files last changed before their time ran out; files (path, modificationTime, ...) as the file source lists them."""
    return files.filter(F.expr(f"modificationTime < {now} - interval {seconds} seconds")).select("path")


def delete(spark: SparkSession, paths: DataFrame) -> int:
    """Delete files (path) by the file system that their path names; gives how many were there."""
    jvm, conf, done = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for row in paths.select("path").toLocalIterator():
        file = jvm.org.apache.hadoop.fs.Path(row.path)
        done += bool(file.getFileSystem(conf).delete(file, False))
    return done


def expanded(responses: DataFrame) -> DataFrame:
    """One row per file of each archive's response (zip_name, files): name, status "done" or "error", markdown, optimized, error.

    An edited text that is missing is the converted one; a response without files has no rows.
    """
    f = responses.select("zip_name", F.posexplode("files").alias("nth", "f"))
    ok = F.coalesce(F.col("f.success"), F.lit(False))
    return f.select(
        "zip_name", "nth", F.col("f.filename").alias("name"), F.when(ok, "done").otherwise("error").alias("status"), F.when(ok, F.coalesce("f.markdown", F.lit(""))).alias("markdown"),
        F.when(ok, F.coalesce(F.nullif("f.optimized_markdown", F.lit("")), "f.markdown", F.lit(""))).alias("optimized"), F.when(~ok, F.coalesce("f.error", F.lit("failed"))).alias("error"),
    )


def archive_of(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted (path) met with files (path, data): what is there, and the paths that are not (skipped)."""
    return wanted.join(files, "path"), wanted.join(files.select("path"), "path", "left_anti")


def summary(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, summary): one line with passes, tokens before and after, and the percentage saved."""
    line = F.format_string("%d passes executed, %d failed | %s → %s tokens (%.1f%% saved)", "passes", "errors", T.format_count(F.col("original_tokens")), T.format_count(F.col("final_tokens")), "percent_saved")
    return reports.select(key, line.alias("summary"))


def zip_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, archive): a ZIP of a document's chunks as numbered Markdown files."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk_idx").to_pylist(), table.column("chunk").to_pylist()))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in rows:
                z.writestr(zipfile.ZipInfo(f"{table.column(key)[0].as_py()}_chunk_{i + 1:03d}.md"), text)
        return pa.table({key: table.column(key).slice(0, 1), "archive": pa.array([out.getvalue()], pa.binary())})

    return chunks.select(key, "chunk_idx", "chunk").groupBy(key).applyInArrow(work, f"{key} long, archive binary")


def lookup(results: DataFrame, file_id: str, now: str = "current_timestamp()") -> DataFrame:
    """(file_id, status, markdown) of one result: 404 unknown, 409 failed, 410 expired, 200."""
    one = results.filter(F.col("file_id") == file_id)
    status = F.when(~F.col("success"), 409).when(expired(now), 410).otherwise(200)
    found = one.select("file_id", status.alias("status"), F.when(status == 200, F.col("markdown")).alias("markdown"))
    asked = results.sparkSession.createDataFrame([(file_id,)], "file_id string")
    return asked.join(found, "file_id", "left").select("file_id", F.coalesce("status", F.lit(404)).alias("status"), "markdown")


def expired(now: str = "current_timestamp()", seconds: int = TTL_S):
    return F.expr(f"uploaded_at < {now} - interval {seconds} seconds")


def evict(registry: DataFrame, now: str = "current_timestamp()", seconds: int = TTL_S) -> DataFrame:
    """The registry without entries past their time."""
    return registry.filter(~expired(now, seconds))


def stats(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, chars, words, tokens and their display forms."""
    t = F.coalesce(F.col(content), F.lit(""))
    df = docs.select("doc_id", F.length(t).cast("long").alias("chars"), T.words(t).alias("words"), T.tokens(t).alias("tokens"))
    return df.withColumns({"tokens_text": T.format_count(F.col("tokens")), "size_text": T.bytes_text(F.col("chars"))})


def new_files(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Files whose name is not staged yet."""
    return files.join(staged.select("name"), "name", "left_anti")


def recent(history: DataFrame, most: int = 30) -> DataFrame:
    """The newest entries, newest first."""
    return history.orderBy(F.desc("at"), "file_id").limit(most)


def significant(issues: str = "issues"):
    """Issues above information."""
    return F.filter(issues, lambda i: i["severity"] != "info")


def markdown_report(reports: DataFrame) -> DataFrame:
    """(doc_id, report): a Markdown summary with one line for each pass."""
    rows = F.array_join(F.transform("history", lambda h: F.format_string("| %s | %d | %d | %d |", h["pass_name"], h["tokens_before"], h["tokens_after"], h["tokens_before"] - h["tokens_after"])), "\n")
    errors = F.array_join(F.transform(F.filter("history", lambda h: h["error"].isNotNull()), lambda h: F.format_string("- %s: %s", h["pass_name"], h["error"])), "\n")
    head = F.format_string("# Optimization report\n\n- Passes: %d\n\n| Pass | Before | After | Saved |\n| --- | --- | --- | --- |\n", F.size("history"))
    return reports.select("doc_id", F.concat(head, rows, F.when(errors != "", F.concat(F.lit("\n\n## Errors\n\n"), errors)).otherwise("")).alias("report"))


def batch_totals(done: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    n = T.free_name(rows, "n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter(F.col(n) == 1).drop(n)


def archive_rows(table: Iterator[tuple[str, bytes]]) -> bytes:
    """A ZIP of (name, bytes)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in table:
            z.writestr(name, data)
    return out.getvalue()
