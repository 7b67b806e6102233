"""A Markdown corpus derived from ``documents`` by the same arithmetic in Spark SQL and in DuckDB.

The raw texts have no headings, tables, citations, pages, code or equations; these are added by position, so
that every operator has something to do and both engines see the same characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table


def _content(spark: bool) -> str:
    nl = "'\\n'" if spark else "chr(10)"
    each = (lambda a, e: f"transform({a}, (x, i) -> {e.replace('IDX', 'i')})") if spark else (lambda a, e: f"list_transform({a}, lambda x, i: {e.replace('IDX', '(i - 1)')})")
    text = lambda e: f"cast({e} as string)" if spark else f"cast({e} as varchar)"
    array = (lambda *xs: f"array({', '.join(xs)})") if spark else (lambda *xs: f"[{', '.join(xs)}]")
    join = (lambda a: f"array_join({a}, {nl} || {nl})") if spark else (lambda a: f"array_to_string({a}, {nl} || {nl})")
    first = "lines[0]" if spark else "lines[1]"
    flat = "flatten"
    n = "size(lines)" if spark else "len(lines)"
    line = (
        f"(case when IDX % 5 = 0 then '## Part ' || {text('IDX div 5' if spark else 'IDX // 5')} || {nl} || {nl} else '' end) || x || "
        f"(case when IDX % 4 = 0 then ' [' || {text('IDX % 9 + 1')} || ', 12]' when IDX % 4 = 2 then ' (Smith et al., 20' || {text('10 + IDX % 20')} || ')' "
        f"when IDX % 4 = 3 then ' see `[7]` there' else '' end) || "
        f"(case when IDX % 6 = 5 then {nl} || {nl} || 'Page ' || {text('IDX div 6 + 1' if spark else 'IDX // 6 + 1')} || ' of 9' || {nl} || {nl} || '---' || {nl} || {nl} || 'Journal of ' || source || ' - ' || {text('IDX')} else '' end)"
    )
    q = lambda s: "'" + s + "'"
    rows = lambda *xs: f" || {nl} || ".join(xs)
    repeat = f"case when doc_id % 3 = 0 then {array(first, first + ' || ' + q(' !'))} else {array(first)} end"
    often = q("They use Quantum Key Distribution; later Quantum Key Distribution grows, and later Quantum Key Distribution stays.")
    phrase = f"case when doc_id % 2 = 0 then {array(often)} else {array(q('Nothing here to shorten at all, it should be noted that this stays.'))} end"
    plain = rows(q("| Item | Value |"), q("| --- | --- |"), f"{q('| lines | ')} || {text(n)} || {q(' |')}", f"{q('| id | ')} || {text('doc_id')} || {q(' |')}")
    tables = f"case when doc_id % 2 = 1 then {array(plain)} else {array(rows(q('| Group | p-value | n |'), q('|---|---|---|'), q('| a | 0.05 | 12 |')))} end"
    sheet = f"case when doc_id % 5 = 0 then {array(q('This is to certify that the reader has successfully completed the text.'))} when doc_id % 5 = 1 then {array(q('Evaluation sheet of the reader'))} else {array(q('No paper was handed out.'))} end"
    tail = array(
        rows(q("```"), q("# comment (cid:3)"), q("| a |"), q("```")),
        f"{q('The (cid:12) value of someWord is $x_1 = ')} || {text('doc_id')} || {q('$ and $$y = 1.5e3$$ here , now.')}",
        rows(q("The report was wrapped"), q("over two lines and holds 3.14 MB, v1.2.3 and NASA.")),
        q("# References"), rows(q("[1] A. Author, A Title, 2010."), q("[2] B. Author, Another Title, 2011.")),
        q("# Acknowledgements"), q("We thank all readers of this text."), q("# Funding"), q("The work was paid for by the readers."), q("## Conflicts of Interest"), q("There are none to be told."),
        q("# Ethics Statement"), q("No reader was harmed by the text."), q("# Author Contributions"), q("All of them wrote all of it."), q("# Data Availability"), q("It is there for all who ask for it."), q("# Appendix"), q("More follows in the appendix here."),
    )
    head = array("'# Doc ' || " + text("doc_id"))
    return join(f"{flat}({array(head, each('lines', line), repeat, phrase, sheet, tables, tail)})")


SQL = f"md AS (SELECT doc_id, {_content(False)} AS content FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content) over all documents."""
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    return rows.select("doc_id", F.expr(_content(True)).alias("content"))
