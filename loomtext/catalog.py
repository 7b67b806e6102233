"""Every query of the engine's own operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import text as T
from .operators import chunking, native, relations, research, scoring
from .plans import corpus, passes
from .plans.corpus import md_docs
from .session import cut, table
from .sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WITH = f"WITH {corpus.SQL} "


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def lit(pattern: str) -> str:
    """A pattern as a DuckDB string; its regular expressions have no escapes for code points."""
    for point in ("2013", "2014", "2019"):
        pattern = pattern.replace("\\u" + point, chr(int(point, 16)))
    return "'" + pattern.replace("'", "''") + "'"


LINES = ", ln AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM md) "
TOKENS = "CAST(CASE WHEN {0} = '' THEN 0 ELSE greatest(1, length({0}) // 4) END AS BIGINT)"
#: Zones that edits leave alone, and an edit of the rest, in DuckDB.
ZONES = lit(T.ZONES)


def outside(text: str, edit: Callable[[str], str], zones: str = ZONES) -> str:
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, {zones}), list_append(regexp_extract_all({text}, {zones}), '')), lambda z: {edit('z[1]')} || coalesce(z[2], '')), '')"


def digest(column: str) -> Column:
    return F.md5(F.col(column).cast("binary")).alias("digest")


# Shared primitives.


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, format('{:,}', length(text)) AS shown FROM documents")
def word_char_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), T.words(F.col("text")).alias("words"), T.format_count(F.length("text")).alias("shown"))


@query(WITH + "SELECT doc_id, md5(content) AS digest FROM md")
def md_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md_docs(spark, sf_dir).select("doc_id", digest("content"))


@query(WITH + LINES + r", f AS (SELECT *, regexp_matches(line, '^\s*```') AS is_fence FROM ln), s AS (SELECT *, sum(is_fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM f) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_fence OR seen % 2 = 1) AS code_lines FROM s GROUP BY doc_id")
def line_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.lines(md_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("in_code").alias("code_lines"))


@query(WITH + r", p AS (SELECT doc_id, unnest(regexp_split_to_array(content, '\n\n+')) AS t FROM md) SELECT doc_id, count(*) AS n_paras, count(*) FILTER (regexp_matches(t, '^\s*(#{1,6}\s|```)')) AS n_protected, CAST(sum(length(t)) AS BIGINT) AS chars FROM p WHERE trim(t) <> '' GROUP BY doc_id")
def paragraph_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.paragraphs(md_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_paras"), F.count_if("is_protected").alias("n_protected"), F.sum(F.length("text")).alias("chars"))


SECTIONS = LINES + r", s AS (SELECT *, sum(regexp_matches(line, '^#{1,6}\s+\S')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_idx FROM ln), sec AS (SELECT doc_id, sec_idx, arg_min(line, line_no) AS first, min(line_no) AS start_line, max(line_no) + 1 AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS body FROM s GROUP BY 1, 2) "


@query(WITH + SECTIONS + r"SELECT doc_id, CAST(sec_idx AS BIGINT) AS sec_idx, CAST(length(regexp_extract(first, '^(#{1,6})\s', 1)) AS INT) AS level, regexp_extract(first, '^#{1,6}\s+(.*)$', 1) AS heading, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM sec")
def section_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.sections(md_docs(spark, sf_dir)).drop("body")


# Base cleaner.

_H1 = LINES + r", h AS (SELECT *, regexp_matches(trim(line), '^#{1,6}\s+\S') AS is_h, sum(regexp_matches(trim(line), '^#\s')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS scope FROM ln), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope, trim(line) ORDER BY line_no) AS n FROM h) "


@query(WITH + _H1 + "SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_h OR n = 1)) AS digest FROM k GROUP BY doc_id")
def heading_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md_docs(spark, sf_dir).withColumn("content", native.heading_dedup(F.col("content"))).select("doc_id", digest("content"))


_PARAS = r", p AS (SELECT doc_id, unnest(regexp_split_to_array(content, '\n\n+')) AS t, generate_subscripts(regexp_split_to_array(content, '\n\n+'), 1) AS i FROM md), q AS (SELECT *, lag(trim(t)) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p) "


@query(WITH + _PARAS + "SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (i = 1 OR trim(t) = '' OR trim(t) <> before)) AS digest FROM q GROUP BY doc_id")
def consecutive_para_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md_docs(spark, sf_dir).withColumn("content", native.paragraph_dedup(F.col("content"))).select("doc_id", digest("content"))


def _cleaned(docs: DataFrame) -> DataFrame:
    for step in native.base_clean(F.col("content")):
        docs = docs.withColumn("content", step(F.col("content")))
    return docs


_CLEAN = (
    WITH.replace("md AS", "raw AS", 1)
    + r""", md AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)[ \t]+$', '', 'g'), """
    + lit(f"(?mi)^{P.PAGE_NUMBER}$")
    + r""", '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?:\n[-*_]{3,}\n){2,}', chr(10) || '---' || chr(10), 'g') AS content FROM raw)"""
    + _H1
    + ", d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_h OR n = 1) AS content FROM k GROUP BY doc_id)"
    + _PARAS.replace("FROM md", "FROM d")
    + r"SELECT doc_id, md5(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (i = 1 OR trim(t) = '' OR trim(t) <> before), '^\s+|\s+$', '', 'g')) AS digest FROM q GROUP BY doc_id"
)


@query(_CLEAN)
def base_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(md_docs(spark, sf_dir)).select("doc_id", digest("content"))


# Character repair.


@query(WITH + f"SELECT doc_id, md5({outside('content', lambda z: f'regexp_replace({z}, {lit(P.CID)}, {lit("")}, {lit("g")})')}) AS digest FROM md")
def ocr_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.outside(F.col("content"), T.ZONES, lambda x: F.regexp_replace(x, P.CID, ""))
    return md_docs(spark, sf_dir).withColumn("content", text).select("doc_id", digest("content"))


@query(WITH + f"SELECT doc_id, md5({outside('content', lambda z: f'regexp_replace({z}, {lit(P.CAMEL)}, {lit(chr(92) + "1 " + chr(92) + "2")}, {lit("g")})')}) AS digest FROM md")
def ocr_camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.outside(F.col("content"), T.ZONES, lambda x: F.regexp_replace(x, P.CAMEL, "$1 $2"))
    return md_docs(spark, sf_dir).withColumn("content", text).select("doc_id", digest("content"))


@query(WITH + f"SELECT doc_id, md5({outside('content', lambda z: f'regexp_replace({z}, {lit(P.WRAPPED)}, {lit(chr(92) + "1 " + chr(92) + "2")}, {lit("g")})')}) AS digest FROM md")
def ocr_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.outside(F.col("content"), T.ZONES, lambda x: F.regexp_replace(x, P.WRAPPED, "$1 $2"))
    return md_docs(spark, sf_dir).withColumn("content", text).select("doc_id", digest("content"))


@query(WITH + r"SELECT doc_id, CAST(len(regexp_extract_all(content, '\(cid:\d+\)')) AS BIGINT) AS cid, CAST(len(regexp_extract_all(content, '([a-z])([A-Z][a-z])')) AS BIGINT) AS camel, CAST(len(regexp_extract_all(content, '\s+[.,;:!?]')) AS BIGINT) AS spaced FROM md")
def ocr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = native.ocr_counts(F.col("content"))
    return md_docs(spark, sf_dir).select("doc_id", counts["cid"].cast("long").alias("cid"), counts["camel"].cast("long").alias("camel"), counts["spaced_punctuation"].cast("long").alias("spaced"))


# Pages, boilerplate.

_FP = (
    r"CASE WHEN regexp_matches(trim(line), '^[0-9]+$') THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(line)), '\s+', ' ', 'g'), '\s*[-–—]\s*[0-9]+\s*$', ''), '\s*\|\s*[0-9]+\s*$', ''), '\bpage\s+[0-9]+(\s+of\s+[0-9]+)?\b', '', 'g'), '\s+', ' ', 'g')) END"
)
_ZONE = (
    LINES
    + r""", c AS (SELECT *, regexp_matches(line, '^\s*[-*_]{3,}\s*$') AS cut FROM ln), r AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS raw FROM c),
    k AS (SELECT * FROM r WHERE NOT cut AND trim(line) <> ''), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, raw ORDER BY line_no) AS top, row_number() OVER (PARTITION BY doc_id, raw ORDER BY line_no DESC) AS foot, dense_rank() OVER (PARTITION BY doc_id ORDER BY raw) AS page FROM k),
    y AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n_pages FROM z), x AS (SELECT *, 'header' AS zone FROM y WHERE top <= 5 UNION ALL SELECT *, 'footer' AS zone FROM y WHERE foot <= 5), """
    + f"w AS (SELECT *, {_FP} AS fingerprint FROM x WHERE n_pages >= 3), g AS (SELECT doc_id, zone, fingerprint, count(DISTINCT page) AS pages, count(DISTINCT line_no) AS lines, arg_min(line, line_no) AS example, max(n_pages) AS n_pages FROM w WHERE fingerprint <> '' GROUP BY 1, 2, 3) "
)


@query(WITH + _ZONE + r"SELECT doc_id, zone, fingerprint, pages, lines, example FROM g WHERE pages / n_pages >= 0.5 AND length(trim(example)) BETWEEN 2 AND 200 AND NOT regexp_matches(example, '^\s*#{1,6}\s+')")
def header_footer_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.recurring_lines(md_docs(spark, sf_dir))


@query(WITH + LINES + f"SELECT doc_id, count(*) FILTER (regexp_matches(line, {lit('(?i)' + P.PAGE_LINE)})) AS n FROM ln GROUP BY doc_id")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.lines(md_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(F.col("line").rlike("(?i)" + P.PAGE_LINE)).alias("n"))


@query(r"WITH ln AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM ln WHERE line <> '' AND length(line) <= 80 GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).withColumn("line", T.strip(F.col("line")))
    return rows.filter((F.col("line") != "") & (F.length("line") <= 80)).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 3")


@query(WITH + f", p AS (SELECT doc_id, unnest(string_split(content, chr(10) || chr(10))) AS t FROM md) SELECT doc_id, count(*) FILTER (regexp_matches(t, {lit('(?i)' + P.CERTIFICATE)})) AS certificates, count(*) FILTER (regexp_matches(t, {lit('(?mi)' + P.EVALUATION)})) AS evaluations FROM p GROUP BY doc_id")
def cert_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = md_docs(spark, sf_dir).select("doc_id", F.explode(T.paragraphs(F.col("content"))).alias("t"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("t").rlike("(?i)" + P.CERTIFICATE)).alias("certificates"), F.count_if(F.col("t").rlike("(?dmi)" + P.EVALUATION)).alias("evaluations"))


# Sections.

_TITLED = (
    LINES
    + r", h AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) AS level, max(line_no) OVER (PARTITION BY doc_id) + 1 AS last FROM ln), hh AS (SELECT *, lower(trim(regexp_replace(regexp_extract(line, '^#{1,6}\s+(.*)$', 1), '[*_:]', '', 'g'))) AS title FROM h WHERE level > 0), "
    r"b AS (SELECT a.doc_id, a.line_no AS start_line, a.level, a.title, coalesce(min(e.line_no), any_value(a.last)) AS end_line FROM hh a LEFT JOIN hh e ON e.doc_id = a.doc_id AND e.line_no > a.line_no AND e.level <= a.level GROUP BY 1, 2, 3, 4) "
)
_NAMES = ", ".join(lit(t) for t in P.REFERENCE_TITLES)


@query(WITH + _TITLED + f"SELECT doc_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(level AS INT) AS level, 'references' AS grp FROM b WHERE title IN ({_NAMES})")
def reference_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.titled_sections(md_docs(spark, sf_dir), relations.title_table(spark, {"references": P.REFERENCE_TITLES}))


@query(
    WITH + _TITLED + f"SELECT b.doc_id, any_value(h.line) AS heading, CAST(b.level AS INT) AS level, CAST(b.start_line AS INT) AS start_line, CAST(b.end_line AS INT) AS end_line, "
    f"CAST(count(*) FILTER (WHERE trim(l.line) <> '') AS INT) AS content_lines FROM b JOIN ln h ON h.doc_id = b.doc_id AND h.line_no = b.start_line JOIN ln l ON l.doc_id = b.doc_id AND l.line_no > b.start_line AND l.line_no < b.end_line "
    f"WHERE b.title IN ({_NAMES}) GROUP BY b.doc_id, b.level, b.start_line, b.end_line"
)
def section_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference section that the pass took out, from its details in the history."""
    done = passes.run(md_docs(spark, sf_dir), passes.Pipeline(("reference_section_removal",)))
    found = F.from_json(F.col("history")[0]["details"], "sections array<struct<heading:string,level:int,start_line:int,end_line:int,content_lines:int>>")["sections"]
    return done.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


_GROUPS = ", ".join(f"({lit(t)}, {lit(min(g for g, us in P.BOILERPLATE_TITLES.items() if t in us))})" for t in sorted({t for ts in P.BOILERPLATE_TITLES.values() for t in ts}))


@query(WITH + _TITLED + f", t(title, grp) AS (VALUES {_GROUPS}) SELECT grp, count(*) AS sections, CAST(sum(end_line - start_line) AS BIGINT) AS lines FROM b JOIN t USING (title) GROUP BY grp")
def boilerplate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.titled_sections(md_docs(spark, sf_dir), relations.title_table(spark))
    return found.groupBy("grp").agg(F.count("*").alias("sections"), F.sum(F.col("end_line") - F.col("start_line")).alias("lines"))


@query(WITH + _TITLED + r", r AS (SELECT b.doc_id, count(*) FILTER (regexp_matches(l.line, '^\s*\[\d+\]')) AS bracketed, count(*) FILTER (regexp_matches(l.line, '^\s*\d{1,4}\.\s')) AS numbered FROM b JOIN ln l ON l.doc_id = b.doc_id AND l.line_no > b.start_line AND l.line_no < b.end_line WHERE title = 'references' GROUP BY 1) SELECT doc_id, greatest(bracketed, numbered) AS entries FROM r")
def reference_entry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = md_docs(spark, sf_dir)
    found = relations.titled_sections(docs, relations.title_table(spark, {"references": ("references",)}))
    rows = relations.lines(docs).join(found, "doc_id").filter("line_no > start_line and line_no < end_line")
    return rows.groupBy("doc_id").agg(F.greatest(*[F.count_if(F.col("line").rlike(p)) for p in P.ENTRIES[:2]]).alias("entries"))


# Citations.


_CITE_ZONES = lit(r"```[\s\S]*?```|`[^`\n]+`|\$\$[\s\S]*?\$\$|\$[^$\n]+\$|\\\[[\s\S]*?\\\]|\\\([^\n]*?\\\)|!?\[[^\]]*\]\([^)]*\)|\[[^\]]*[a-zA-Z][^\]]*\]\[[^\]]*\]|\[\^[^\]]+\]")


def _cited(pattern: str) -> str:
    """SQL: matches of a pattern in the parts outside of the zones."""
    return f"coalesce(list_sum(list_transform(regexp_split_to_array(content, {_CITE_ZONES}), lambda z: len(regexp_extract_all(z, {lit(pattern)})))), 0)"


@query(
    WITH + f", c AS (SELECT doc_id, CAST({_cited(P.NUMERIC_CITATION)} AS BIGINT) AS numeric_n, CAST({_cited(P.AUTHOR_CITATION)} AS BIGINT) AS author_n, "
    f"CAST(len(regexp_extract_all(content, {lit(P.NUMERIC_CITATION)})) + len(regexp_extract_all(content, {lit(P.AUTHOR_CITATION)})) AS BIGINT) AS n FROM md) "
    "SELECT doc_id, numeric_n, author_n, greatest(n - numeric_n - author_n, 0) AS protected_n FROM c"
)
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = passes.get("citation_removal")
    counts = item.counts(F.col("content"), item.settings(None))
    return md_docs(spark, sf_dir).select("doc_id", *[counts[k].cast("long").alias(a) for k, a in (("numeric", "numeric_n"), ("author_year", "author_n"), ("protected", "protected_n"))])


_CITE = lit(f"{P.NUMERIC_CITATION}|{P.AUTHOR_CITATION}")


@query(
    WITH + ", e AS (SELECT doc_id, " + outside("content", lambda z: f"regexp_replace({z}, {_CITE}, '', 'g')", _CITE_ZONES)
    + r" AS t FROM md) SELECT doc_id, md5(regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g')) AS digest FROM e"
)
def citation_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = md_docs(spark, sf_dir)
    for step in native.citations(passes.get("citation_removal").settings(None)):
        docs = docs.withColumn("content", step(F.col("content")))
    return docs.select("doc_id", digest("content"))


@query(
    WITH + f", c AS (SELECT doc_id, CAST({_cited(P.NUMERIC_CITATION)} AS BIGINT) AS numeric_bracket, CAST({_cited(P.AUTHOR_CITATION)} AS BIGINT) AS author_year, "
    f"flatten(list_transform(regexp_split_to_array(content, {_CITE_ZONES}), lambda z: regexp_extract_all(z, {_CITE}))) AS found FROM md) "
    "SELECT doc_id, numeric_bracket + author_year AS total_removed, numeric_bracket, author_year, array_to_string(found[1:20], chr(10)) AS examples FROM c"
)
def removed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report says of citations taken out, and the first ones from the history."""
    done = passes.run(md_docs(spark, sf_dir), passes.Pipeline(("citation_removal",)))
    said = F.from_json(passes.content_removed(F.col("history")), "citations struct<total_removed:bigint,numeric_bracket:bigint,author_year:bigint>")["citations"]
    first = F.from_json(F.col("history")[0]["details"], "examples array<struct<text:string>>")["examples"]["text"]
    return done.select("doc_id", said.alias("said"), F.array_join(first, "\n").alias("examples")).select("doc_id", "said.*", "examples")


@query()
def content_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five passes of the balanced mode took out, as JSON."""
    done = passes.run(_cleaned(md_docs(spark, sf_dir)), passes.Pipeline.mode("balanced"))
    return done.select("doc_id", passes.content_removed(F.col("history")).alias("content_removed"))


# Tables.


@query(
    WITH + LINES
    + r""", t AS (SELECT *, regexp_matches(line, '^\s*\|(.+)\|\s*$') AS is_row FROM ln), u AS (SELECT *, sum((is_row AND NOT coalesce(before, false))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, lag(is_row) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM t)),
    v AS (SELECT doc_id, run, line_no, list_filter(list_transform(string_split(regexp_extract(line, '^\s*\|(.+)\|\s*$', 1), '|'), lambda c: trim(c)), lambda c: c <> '') AS cells, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS nth FROM u WHERE is_row),
    w AS (SELECT doc_id, run, min(line_no) AS start_line, max(line_no) + 1 AS end_line, max(CASE WHEN nth = 1 THEN len(cells) END) AS columns, count(*) AS n, bool_or(nth = 2 AND len(cells) > 0 AND len(list_filter(cells, lambda c: NOT regexp_matches(c, '^:?-+:?$'))) = 0) AS ruled FROM v GROUP BY 1, 2)
    SELECT doc_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(columns AS BIGINT) AS columns, n - 2 AS data_rows FROM w WHERE ruled AND n >= 3 AND columns > 0"""
)
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.table_runs(md_docs(spark, sf_dir))


@query("SELECT o_custkey, string_agg('- ' || CAST(o_orderkey AS VARCHAR) || ': ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS bullets FROM orders GROUP BY o_custkey")
def table_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("b", F.concat(F.lit("- "), F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderpriority"))
    return rows.groupBy("o_custkey").agg(F.expr("listagg(b, '\\n') within group (order by o_orderkey)").alias("bullets"))


def _one_pass(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = passes.run(md_docs(spark, sf_dir), passes.Pipeline((name,)))
        last = F.element_at("history", -1)
        return done.select("doc_id", digest("content"), last["tokens_before"].alias("tokens_before"), last["tokens_after"].alias("tokens_after"))

    return run


for _name in passes.REGISTRY:
    QUERIES[f"pass_{_name}"] = _one_pass(_name)


@query()
def pass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that each pass of the aggressive mode writes."""
    done = passes.run(md_docs(spark, sf_dir), passes.Pipeline.mode("aggressive"))
    each = done.select("doc_id", F.posexplode("history").alias("nth", "h")).select("doc_id", "nth", F.col("h.pass_name").alias("pass_name"), F.explode("h.metrics").alias("metric", "value"))
    return each


def _pass_sql(edited: str) -> str:
    """SQL of a pass query; edited: the relations up to ``done (doc_id, content)``, the text after the pass."""
    return WITH + edited + f" SELECT md.doc_id, md5(done.content) AS digest, {TOKENS.format('md.content')} AS tokens_before, {TOKENS.format('done.content')} AS tokens_after FROM md JOIN done USING (doc_id)"


def _tidy(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_JOINED = "string_agg(line, chr(10) ORDER BY line_no)"
#: Lines whose document loses none of them are left as they are, also where they are not tidy.
_REBUILT = f"done AS (SELECT doc_id, CASE WHEN bool_or(gone) THEN {_tidy(f'coalesce({_JOINED} FILTER (NOT gone), {lit("")})')} ELSE {_JOINED} END AS content FROM u GROUP BY doc_id)"


def _sections_sql(titles: str) -> str:
    found = f", f AS (SELECT DISTINCT doc_id, start_line, end_line FROM b WHERE title IN ({titles}))"
    gone = ", u AS (SELECT ln.*, EXISTS (SELECT 1 FROM f WHERE f.doc_id = ln.doc_id AND ln.line_no >= f.start_line AND ln.line_no < f.end_line) AS gone FROM ln), "
    return _TITLED + found + gone + _REBUILT


_BOILERPLATE = ", ".join(lit(t) for t in sorted({t for ts in P.BOILERPLATE_TITLES.values() for t in ts}))
ORACLE["pass_equation_restoration"] = _pass_sql(", done AS (SELECT doc_id, content FROM md)")
ORACLE["pass_citation_removal"] = _pass_sql(ORACLE["citation_clean"].removeprefix(WITH).split(" SELECT doc_id, md5(")[0] + r", done AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g') AS content FROM e)")
ORACLE["pass_reference_section_removal"] = _pass_sql(_sections_sql(_NAMES))
ORACLE["pass_boilerplate_section_removal"] = _pass_sql(_sections_sql(_BOILERPLATE))

_CELLS = r"list_transform(string_split(regexp_extract(line, '^\s*\|(.*)\|\s*$', 1), '|'), lambda c: trim(c))"
_BLOCKS = (
    LINES
    + rf""", t AS (SELECT *, regexp_matches(line, '^\s*\|(.+)\|\s*$') AS is_row FROM ln), o AS (SELECT *, lag(is_row) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM t),
    r AS (SELECT *, sum((is_row AND NOT coalesce(before, false))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM o),
    c AS (SELECT *, {_CELLS} AS cells, row_number() OVER (PARTITION BY doc_id, run, is_row ORDER BY line_no) AS nth FROM r),
    w AS (SELECT doc_id, run, min(line_no) AS start_line, max(line_no) + 1 AS end_line, count(*) AS n, string_agg(line, chr(10) ORDER BY line_no) AS whole,
        list_filter(max(CASE WHEN nth = 1 THEN cells END), lambda x: x <> '') AS head, max(CASE WHEN nth = 2 THEN cells END) AS rule FROM c WHERE is_row GROUP BY 1, 2),
    above AS (SELECT w.doc_id, w.run, arg_max(l.line, l.line_no) AS caption FROM w JOIN ln l ON l.doc_id = w.doc_id AND l.line_no < w.start_line AND trim(l.line) <> '' GROUP BY 1, 2),
    g AS (SELECT w.*, len(head) > 0 AND n >= 3 AND len(list_filter(rule, lambda x: x <> '')) > 0 AND len(list_filter(rule, lambda x: x <> '' AND NOT regexp_matches(x, '^\s*:?-+:?\s*$'))) = 0 AS is_table,
        regexp_matches(whole, {lit("(?i)" + P.SCIENTIFIC)}) OR regexp_matches(array_to_string(head, ' '), {lit("(?i)" + P.UNIT)}) OR regexp_matches(coalesce(caption, ''), {lit("(?i)" + P.CAPTION)}) AS scientific
        FROM w LEFT JOIN above USING (doc_id, run))"""
)


def _tables_sql(least: int, header: str, body: str) -> str:
    """A pass over tables: SQL for what becomes of the header line (head) and of a body line (head, v)."""
    return (
        _BLOCKS
        + f", d AS (SELECT c.doc_id, c.line_no, CASE WHEN c.nth = 1 THEN {header} ELSE {body} END AS line, c.nth = 2 AS gone FROM (SELECT c.*, head, list_resize(cells, len(head), '') AS v FROM c JOIN g USING (doc_id, run) WHERE c.is_row AND is_table AND NOT scientific AND n - 2 >= {least} AND len(head) <= 10) c), "
        f"e AS (SELECT ln.doc_id, ln.line_no, coalesce(d.line, ln.line) AS line, coalesce(d.gone, false) AS gone FROM ln LEFT JOIN d ON d.doc_id = ln.doc_id AND d.line_no = ln.line_no), "
        f"u AS (SELECT * FROM e), {_REBUILT}"
    )


ORACLE["pass_table_compression"] = _pass_sql(_tables_sql(2, "CASE WHEN len(head) = 2 THEN head[1] || head[2] ELSE array_to_string(head, '|') END || ':'", "CASE WHEN len(head) = 2 THEN v[1] || '=' || v[2] ELSE array_to_string(v, '|') END"))
ORACLE["pass_semantic_table_transform"] = _pass_sql(
    _tables_sql(
        1,
        "CASE WHEN len(head) = 2 THEN head[1] || ' (' || head[2] || '):' ELSE head[1] || ':' END",
        "CASE len(head) WHEN 1 THEN '- ' || v[1] WHEN 2 THEN '- ' || v[1] || ': ' || v[2] ELSE '- ' || v[1] || ':' || array_to_string(list_transform(list_zip(head[2:], v[2:]), lambda z: chr(10) || '  - ' || z[1] || ': ' || z[2]), '') END",
    )
)

_CODE = r", f AS (SELECT *, regexp_matches(line, '^\s*```') AS is_fence FROM ln), s AS (SELECT *, is_fence OR sum(is_fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS in_code FROM f)"
_CERTIFIED = f"list_filter(list_filter(string_split(content, chr(10) || chr(10)), lambda x: NOT regexp_matches(x, {lit('(?i)' + P.CERTIFICATE)}) OR contains(x, '```')), lambda x: NOT regexp_matches(x, {lit('(?mi)' + P.EVALUATION)}) OR contains(x, '```'))"
ORACLE["pass_content_boilerplate"] = _pass_sql(
    f", cut AS (SELECT doc_id, array_to_string({_CERTIFIED}, chr(10) || chr(10)) AS content FROM md)"
    + LINES.replace("FROM md", "FROM cut")
    + _CODE
    + f", k AS (SELECT * FROM s WHERE in_code OR NOT regexp_matches(line, {lit('(?i)' + P.PAGE_LINE)})), x AS (SELECT *, trim(line) AS bare FROM k), "
    r"q AS (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS n, row_number() OVER (PARTITION BY doc_id, bare ORDER BY line_no) AS nth FROM x), "
    rf"done AS (SELECT doc_id, {_tidy('string_agg(line, chr(10) ORDER BY line_no)')} AS content FROM q WHERE NOT (bare <> '' AND length(bare) <= 80 AND n >= 3 AND nth > 1 AND NOT regexp_matches(bare, '^#{{1,6}}\s+')) GROUP BY doc_id)"
)


# De-duplication.

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(t), '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{Mn}_\s]', '', 'g'))"
_FREE = _PARAS.split(", q AS")[0] + r", c AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_idx, regexp_matches(t, '^\s*(#{1,6}\s|```)') AS is_protected FROM p WHERE trim(t) <> ''), "


ORACLE["pass_global_paragraph_deduplication"] = _pass_sql(
    LINES
    + _CODE
    + r""", i AS (SELECT *, trim(line) <> '' OR in_code AS solid, lag(trim(line) <> '' OR in_code) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM s),
    p AS (SELECT *, sum((solid AND NOT coalesce(was, false))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM i),
    a AS (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY line_no) AS t, bool_or(in_code) AS code FROM p WHERE solid GROUP BY 1, 2),
    """
    + rf"""m AS (SELECT *, NOT code AND NOT regexp_matches(t, '^\s*#{{1,6}}\s') AND length(trim(t)) >= 20 AS able, {_NORMAL} AS form FROM a),
    z AS (SELECT *, able AND row_number() OVER (PARTITION BY doc_id, able, form ORDER BY island) > 1 AS gone FROM m),
    u AS (SELECT p.doc_id, p.line_no, p.line, coalesce(z.gone AND p.solid, false) AS gone FROM p LEFT JOIN z USING (doc_id, island)), """
    + _REBUILT
)


@query(WITH + _FREE + f"k AS (SELECT *, is_protected OR length(trim(t)) < 20 AS free, row_number() OVER (PARTITION BY doc_id, t ORDER BY para_idx) AS n FROM c) SELECT doc_id, count(*) AS kept FROM k WHERE free OR n = 1 GROUP BY doc_id")
def para_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.dedup(relations.paragraphs(md_docs(spark, sf_dir)), "exact").groupBy("doc_id").agg(F.count("*").alias("kept"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised paragraph de-duplication with the tokens before and after, in one pass over the paragraphs."""
    rows = relations.marked(relations.paragraphs(md_docs(spark, sf_dir))).withColumn("n", T.tokens(F.col("text")))
    kept = F.col("is_kept")
    found = rows.groupBy("doc_id").agg(
        F.sum("n").alias("tokens_before"), F.count("*").alias("paras_before"), F.sum(F.when(kept, F.col("n"))).alias("tokens_after"), F.count_if(kept).alias("paras_after"),
    )
    return found.withColumn("tokens_saved", F.greatest(F.col("tokens_before") - F.col("tokens_after"), F.lit(0).cast("long")))


QUERIES["para_dedup_normalized"] = flagship
ORACLE["para_dedup_normalized"] = (
    WITH + _FREE
    + f"k AS (SELECT *, is_protected OR length(trim(t)) < 20 AS free, {TOKENS.format('t')} AS n_tokens, row_number() OVER (PARTITION BY doc_id, is_protected OR length(trim(t)) < 20, {_NORMAL} ORDER BY para_idx) AS n FROM c) SELECT doc_id, CAST(sum(n_tokens) AS BIGINT) AS tokens_before, count(*) AS paras_before, CAST(sum(n_tokens) FILTER (free OR n = 1) AS BIGINT) AS tokens_after, count(*) FILTER (free OR n = 1) AS paras_after, CAST(greatest(0, sum(n_tokens) - sum(n_tokens) FILTER (free OR n = 1)) AS BIGINT) AS tokens_saved FROM k GROUP BY doc_id"
)


@query(WITH + _FREE + f"k AS (SELECT *, {_NORMAL} AS form FROM c WHERE NOT is_protected AND length(trim(t)) >= 20) SELECT doc_id, CAST(min(para_idx) AS INT) AS first_para, count(*) AS copies, substr(arg_min(t, para_idx), 1, 100) AS preview FROM k GROUP BY doc_id, form HAVING count(*) > 1")
def para_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.dedup_groups(relations.paragraphs(md_docs(spark, sf_dir)))


_BITS = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))
_SUM = " | ".join(f"CASE WHEN b{b} > 0 THEN (1::UBIGINT << {b}) ELSE 0::UBIGINT END" for b in range(64))
_SIMHASH = (
    _FREE + f"k AS (SELECT doc_id, para_idx, {_NORMAL} AS form FROM c WHERE NOT is_protected), g AS (SELECT doc_id, para_idx, form, list_filter(string_split(form, ' '), lambda x: x <> '') AS w FROM k), "
    "gr AS (SELECT doc_id, para_idx, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [form] END) AS gram FROM g), "
    f"hh AS (SELECT doc_id, para_idx, md5_number_upper(gram) AS h FROM gr), bb AS (SELECT doc_id, para_idx, {_BITS} FROM hh GROUP BY 1, 2), marks AS (SELECT doc_id, para_idx, {_SUM} AS simhash FROM bb) "
)


@query(WITH + _SIMHASH + "SELECT a.doc_id, CAST(a.para_idx AS INT) AS a, CAST(b.para_idx AS INT) AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS distance FROM marks a JOIN marks b ON a.doc_id = b.doc_id AND a.para_idx < b.para_idx WHERE bit_count(xor(a.simhash, b.simhash)) <= 12")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = relations.paragraphs(md_docs(spark, sf_dir)).filter("not is_protected").withColumn("form", T.normal(F.col("text")))
    return relations.simhash_pairs(relations.simhash(paras, ["doc_id", "para_idx"], "form"))


#: Chunks of one document in ``embeddings``: vectors are compared within a document.
CHUNKS = 100


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as the chunks of documents of CHUNKS chunks each."""
    return table(spark, sf_dir, "embeddings").withColumn("doc", F.expr(f"vec_id div {CHUNKS}"))


_VECTORS = f"v AS (SELECT *, vec_id // {CHUNKS} AS doc, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"WITH {_VECTORS} SELECT a.doc, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.doc = b.doc AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.4")
def semantic_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.similar_vectors(chunk_vectors(spark, sf_dir), 0.4, group="doc").withColumn("similarity", F.round("similarity", 6))


@query(
    f"WITH {_VECTORS}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.doc = b.doc AND a.vec_id <> b.vec_id) "
    "SELECT a, b, n FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS n FROM s) WHERE n <= 50"
)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.nearest(chunk_vectors(spark, sf_dir), 50, group="doc")


# Phrases and importance.

_ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', '_', 'g')"
_STOP = ", ".join(lit(c) for c in P.CONNECTORS)
_PHRASES = (
    f", f AS (SELECT doc_id, unnest(regexp_extract_all(content, {lit(P.PHRASE)}, 1)) AS phrase, generate_subscripts(regexp_extract_all(content, {lit(P.PHRASE)}, 1), 1) AS pos FROM md), "
    "c AS (SELECT doc_id, phrase, count(*) AS frequency, min(pos) AS first_pos FROM f GROUP BY 1, 2), "
    rf"d AS (SELECT *, list_filter(regexp_split_to_array(phrase, '\s+'), lambda w: lower(w) NOT IN ({_STOP})) AS parts, len(regexp_split_to_array(phrase, '\s+')) AS n, max(frequency) OVER (PARTITION BY doc_id) AS most FROM c), "
    "e AS (SELECT *, upper(array_to_string(list_transform(parts, lambda w: w[1]), '')) AS acronym, 0.5 * frequency / most + 0.3 * least(1.0, n / 3) + 0.2 * least(1.0, (length(phrase) - n) / 20.0) AS confidence FROM d), "
    f"x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(content, {lit(P.ACRONYM)})) AS acronym FROM md), "
    "g AS (SELECT * FROM e WHERE frequency >= 3 AND len(parts) >= 2 AND length(acronym) BETWEEN 2 AND 6 AND confidence >= 0.3 AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = e.doc_id AND x.acronym = e.acronym)), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, acronym ORDER BY frequency DESC, first_pos, phrase) AS rank FROM g) "
)


@query(WITH + _PHRASES + "SELECT doc_id, phrase, frequency, acronym, round(confidence, 6) AS confidence FROM h WHERE rank = 1")
def acronym_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.phrases(md_docs(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def _tier_sql(heading: str, body: str) -> str:
    m = lambda c, p: f"regexp_matches({c}, {lit(p)})"
    return (
        f"CASE WHEN {m(heading, '(?i)' + P.TIER1)} THEN 1 WHEN {m(heading, '(?i)' + P.TIER3)} THEN 3 WHEN {m(heading, '(?i)' + P.TIER2)} THEN 2 "
        f"WHEN {m(body, P.EQUATION_SIGN)} OR {m(body, '(?i)' + P.DEFINITION_SIGN)} OR {m(body, '(?i)' + P.ALGORITHM_SIGN)} THEN 1 WHEN {m(body, '(?i)' + P.BOILERPLATE_SIGN)} THEN 3 ELSE 2 END"
    )


_TIERS = SECTIONS + r", t AS (SELECT doc_id, sec_idx, regexp_extract(first, '^#{1,6}\s+(.*)$', 1) AS heading, body FROM sec), tt AS (SELECT *, " + _tier_sql("heading", "body") + " AS tier FROM t) "


@query(WITH + _TIERS + "SELECT doc_id, CAST(sec_idx AS BIGINT) AS sec_idx, heading, tier FROM tt")
def section_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.tiers(relations.sections(md_docs(spark, sf_dir))).select("doc_id", "sec_idx", "heading", "tier")


@query(WITH + _TIERS + "SELECT doc_id, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3 FROM tt GROUP BY doc_id")
def tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.tiers(relations.sections(md_docs(spark, sf_dir)))
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("tier") == k).alias(f"tier{k}") for k in (1, 2, 3)])


def _importance_sql() -> str:
    moderate = f"regexp_replace(body, {lit(P.TIER_CITATION)}, '', 'g')"
    for pattern, new in P.FILLERS:
        moderate = f"regexp_replace({moderate}, {lit('(?i)' + pattern)}, {lit(new)}, 'g')"
    moderate = rf"regexp_replace({moderate}, '[ \t]{{2,}}', ' ', 'g')"
    first = r"list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^#{1,6}\s'))[1]"
    brief = f"array_to_string(list_filter([CASE WHEN heading <> '' THEN top END, {first}], lambda x: x IS NOT NULL), chr(10)) || chr(10) || chr(10)"
    return _pass_sql(
        SECTIONS
        + rf""", t AS (SELECT doc_id, sec_idx, first AS top, trim(regexp_extract(first, '^#{{1,6}}\s+(.*)$', 1)) AS heading, body || CASE WHEN end_line <= max(end_line - 1) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS body FROM sec),
        tt AS (SELECT *, {_tier_sql("heading", "body")} AS tier FROM t), n AS (SELECT doc_id, sec_idx, CASE tier WHEN 1 THEN body WHEN 2 THEN {moderate} ELSE {brief} END AS part FROM tt),
        done AS (SELECT doc_id, {_tidy("string_agg(part, '' ORDER BY sec_idx)")} AS content FROM n GROUP BY doc_id)"""
    )


ORACLE["pass_importance_aware"] = _importance_sql()


def _strip_fillers(c: Column) -> Column:
    for pattern, new in P.FILLERS:
        c = F.regexp_replace(c, "(?i)" + pattern, new)
    return c


def _fillers_sql(c: str) -> str:
    for pattern, new in P.FILLERS:
        c = f"regexp_replace({c}, {lit('(?i)' + pattern)}, {lit(new)}, 'g')"
    return c


@query(WITH + f"SELECT doc_id, md5({_fillers_sql('content')}) AS digest FROM md")
def filler_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md_docs(spark, sf_dir).withColumn("content", _strip_fillers(F.col("content"))).select("doc_id", digest("content"))


# Scores: each document against itself without its tail and its tables.

_EDIT = "regexp_replace(regexp_replace(split_part(content, '# References', 1), '(?m)^[|].*[|]$', '', 'g'), '(?m)^## Part [13]$', '', 'g')"
PAIRS = f", pr AS (SELECT doc_id, content AS original, {_EDIT} AS optimized FROM md) "


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, original, optimized)."""
    edit = F.regexp_replace(F.regexp_replace(F.split_part("content", F.lit("# References"), F.lit(1)), r"(?dm)^[|].*[|]$", ""), r"(?dm)^## Part [13]$", "")
    return md_docs(spark, sf_dir).select("doc_id", F.col("content").alias("original"), edit.alias("optimized"))


def _scores_sql() -> str:
    heads = lambda t: f"list_distinct(list_transform(regexp_extract_all({t}, '(?m)^#{{1,3}}\\s+(.+)$', 1), lambda x: lower(trim(x))))"
    number = lambda t: f"list_distinct(regexp_extract_all({_ASCII.format(t)}, {lit(P.NUMBER)}))"
    entity = lambda t: "list_distinct(" + " || ".join(f"regexp_extract_all({_ASCII.format(t)}, {lit(p)})" for p in P.ENTITIES) + ")"
    rows = lambda t: f"len(list_filter(string_split({t}, chr(10)), lambda x: starts_with(trim(x), '|') AND ends_with(trim(x), '|') AND length(trim(x)) > 2))"
    code = lambda t: f"(len(regexp_extract_all({t}, '```')) // 2)"
    image = lambda t: f"len(regexp_extract_all({t}, {lit(P.IMAGE)}))"
    cols = ", ".join(f"{f(t)} AS {n}{k}" for k, t in (("o", "original"), ("n", "optimized")) for n, f in (("h", heads), ("u", number), ("e", entity), ("t", rows), ("c", code), ("i", image)))
    kept = lambda o, n: f"CASE WHEN len({o}) = 0 THEN 100.0 ELSE (len({o}) - len(list_filter({o}, lambda x: NOT list_contains({n}, x)))) * 100.0 / len({o}) END"
    ratio = lambda o, n: f"CASE WHEN {o} = 0 OR {n} >= {o} THEN 100.0 ELSE {n} * 100.0 / {o} END"
    return (
        f", a AS (SELECT doc_id, {cols} FROM pr), b AS (SELECT * REPLACE (list_filter(uo, lambda x: length(x) >= 3 OR regexp_matches(x, '[A-Za-z]')) AS uo) FROM a), "
        f"s AS (SELECT doc_id, {kept('ho', 'hn')} AS section_score, {ratio('t' + 'o', 'tn')} AS table_score, {kept('uo', 'un')} AS numeric_score, {ratio('co', 'cn')} AS code_score, {ratio('io', chr(105) + 'n')} AS image_score, {kept('eo', 'en')} AS entity_score FROM b) "
    ).replace(" in ", " in ")


_SCORES = WITH + PAIRS + _scores_sql().replace("AS to,", "AS t_o,").replace(" to = 0", " t_o = 0").replace("tn >= to ", "tn >= t_o ").replace("/ to ", "/ t_o ").replace("AS in ", "AS i_n ").replace("OR in >=", "OR i_n >=").replace("in * 100.0", "i_n * 100.0")
_SIX = "CAST(section_score AS DOUBLE) AS section_score, CAST(table_score AS DOUBLE) AS table_score, CAST(numeric_score AS DOUBLE) AS numeric_score, CAST(code_score AS DOUBLE) AS code_score, CAST(image_score AS DOUBLE) AS image_score, CAST(entity_score AS DOUBLE) AS entity_score"
_CONTEXT = "(section_score * 0.25 + table_score * 0.20 + numeric_score * 0.20 + code_score * 0.10 + image_score * 0.10 + entity_score * 0.15)"


def _rounded(name: str) -> str:
    return f"round(CAST({name} AS DOUBLE), 6) AS {name}"


@query(_SCORES + "SELECT doc_id, " + ", ".join(_rounded(f"{k}_score") for k in scoring.WEIGHTS) + " FROM s")
def preservation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(pairs(spark, sf_dir)).select("doc_id", *[F.round(F.col(f"{k}_score").cast("double"), 6).alias(f"{k}_score") for k in scoring.WEIGHTS])


@query(_SCORES + f"SELECT doc_id, round(CAST({_CONTEXT} AS DOUBLE), 6) AS context_score FROM s")
def context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(pairs(spark, sf_dir)).select("doc_id", F.round(F.col("context_score").cast("double"), 6).alias("context_score"))


_BOW = r", tm AS (SELECT doc_id, 0 AS side, unnest(regexp_extract_all(lower(original), '[\p{L}\p{N}_]+')) AS term FROM pr UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(lower(optimized), '[\p{L}\p{N}_]+')) FROM pr), ct AS (SELECT doc_id, term, sum(1 - side) AS a, sum(side) AS b FROM tm GROUP BY 1, 2), bw AS (SELECT doc_id, CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0 END AS bow FROM ct GROUP BY 1) "


@query(WITH + PAIRS + _BOW + "SELECT doc_id, round(bow, 6) AS bow FROM bw")
def bow_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bow_cosine(pairs(spark, sf_dir)).withColumn("bow", F.round("bow", 6))


@query(_SCORES + _BOW + f", o AS (SELECT doc_id, 2 * (bow * 100) * {_CONTEXT} / (bow * 100 + {_CONTEXT}) AS overall FROM s JOIN bw USING (doc_id)) SELECT doc_id, round(CAST(overall AS DOUBLE), 6) AS overall, CASE WHEN overall >= 98 THEN 'Excellent' WHEN overall >= 95 THEN 'Good' WHEN overall >= 90 THEN 'Moderate' ELSE 'Significant Loss' END AS label FROM o")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    both = scoring.scores(p).select("doc_id", "context_score").join(scoring.bow_cosine(p), "doc_id")
    both = both.select("doc_id", scoring.overall(F.col("bow") * 100, F.col("context_score").cast("double")).alias("overall"))
    return both.select("doc_id", F.round("overall", 6).alias("overall"), scoring.label(F.col("overall")).alias("label"))


_STRUCTURE = (
    "(CASE WHEN len(ho) = 0 THEN 1.0 ELSE len(list_filter(ho, lambda x: list_contains(hn, x))) / len(ho) END + CASE WHEN lo = 0 THEN 1.0 ELSE least(1.0, ln / lo) END + "
    "CASE WHEN co = 0 THEN 1.0 ELSE least(1.0, cn / co) END + CASE WHEN po = 0 THEN 1.0 ELSE least(1.0, pn / po) END) / 4"
)


def _structure_sql() -> str:
    parts = {
        "h": lambda t: f"list_distinct(regexp_extract_all({t}, '(?m)^(#{{1,6}}\\s+.+)$', 1))",
        "l": lambda t: f"len(regexp_extract_all({t}, '(?m)^\\s*[-*+]\\s+')) + len(regexp_extract_all({t}, '(?m)^\\s*\\d+\\.\\s+'))",
        "c": lambda t: f"len(regexp_extract_all({t}, '```[\\s\\S]*?```'))",
        "p": lambda t: f"len(list_filter(string_split({t}, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')))",
    }
    return ", st AS (SELECT doc_id, " + ", ".join(f"{f(t)} AS {n}{k}" for k, t in (("o", "original"), ("n", "optimized")) for n, f in parts.items()) + " FROM pr) "


@query(WITH + PAIRS + _structure_sql() + f"SELECT doc_id, round({_STRUCTURE}, 6) AS structure FROM st")
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", F.round(scoring.structure(F.col("original"), F.col("optimized")), 6).alias("structure"))


@query(
    WITH + PAIRS + r", q AS (SELECT doc_id, optimized, regexp_extract_all(original, '\$\$[\s\S]*?\$\$') || list_filter(regexp_extract_all(original, '\$+[^$\n]+\$+'), lambda x: NOT starts_with(x, '$$')) || regexp_extract_all(" + _ASCII.format("original") + r", '\b\d+\.?\d*[eE][+-]?\d+\b') AS eq FROM pr) "
    "SELECT doc_id, round(CASE WHEN len(eq) = 0 THEN 1.0 ELSE len(list_filter(eq, lambda e: contains(optimized, e))) / len(eq) END, 6) AS equation FROM q"
)
def equation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", F.round(scoring.equations(F.col("original"), F.col("optimized")), 6).alias("equation"))


_EQUATION_SQL = r", q AS (SELECT doc_id, optimized, regexp_extract_all(original, '\$\$[\s\S]*?\$\$') || list_filter(regexp_extract_all(original, '\$+[^$\n]+\$+'), lambda x: NOT starts_with(x, '$$')) || regexp_extract_all(" + _ASCII.format("original") + r", '\b\d+\.?\d*[eE][+-]?\d+\b') AS eq FROM pr), eqn AS (SELECT doc_id, CASE WHEN len(eq) = 0 THEN 1.0 ELSE len(list_filter(eq, lambda e: contains(optimized, e))) / len(eq) END AS equation FROM q) "


def _verdict_sql() -> str:
    some = lambda *xs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in xs) + "], lambda x: x IS NOT NULL), ', ')"
    limits = scoring.THRESHOLDS
    warnings = some(("cut > 0.6", "high token reduction"), ("semantic < 0.8", "low semantic similarity"), ("equation < 1.0", "equations lost"), ("structure < 0.7", "low structure preservation"), ("trim(optimized) = ''", "empty output"))
    reasons = some(*[(f"{k} < {limits[k]}", k) for k in ("semantic", "structure", "equation")], (f"cut > {limits['reduction']}", "reduction"))
    t = lambda c: TOKENS.format(c)
    return (
        WITH + PAIRS + _BOW + _structure_sql() + _EQUATION_SQL
        + f", a AS (SELECT pr.doc_id, original, optimized, bow AS semantic, {_STRUCTURE} AS structure, equation, ({t('original')} - {t('optimized')}) / {t('original')} AS cut FROM pr JOIN bw USING (doc_id) JOIN st USING (doc_id) JOIN eqn USING (doc_id)), "
        f"z AS (SELECT *, {warnings} AS warnings, {reasons} AS reasons FROM a) SELECT doc_id, round(semantic, 6) AS semantic, round(structure, 6) AS structure, round(equation, 6) AS equation, round(cut, 6) AS token_reduction, "
        "warnings, reasons, reasons = '' AS passed, md5(CASE WHEN reasons = '' THEN optimized ELSE original END) AS output_digest FROM z"
    )


@query(_verdict_sql())
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scoring.rollback(scoring.validate(pairs(spark, sf_dir)))
    measured = [F.round(k, 6).alias(k) for k in ("semantic", "structure", "equation", "token_reduction")]
    lists = [F.array_join(k, ", ").alias(k) for k in ("warnings", "reasons")]
    return done.select("doc_id", *measured, *lists, "passed", F.md5("output").alias("output_digest"))


@query(r"WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: length(x) > 15) AS ss FROM documents) SELECT doc_id, CASE WHEN len(ss) > 0 THEN (len(ss) + 2) // 3 WHEN trim(text) <> '' THEN 1 ELSE 0 END AS windows, CAST(len(ss) AS BIGINT) AS sentences FROM s")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+", -1), T.strip), lambda s: F.length(s) > 15)
    return docs.select("doc_id", F.size(scoring.sentence_windows(F.col("text"))).cast("long").alias("windows"), F.size(sentences).cast("long").alias("sentences"))


_CUT_VECTORS = "c AS (SELECT doc, vec_id, e, list_transform(e, lambda x, i: CASE WHEN (vec_id + i) % 7 = 0 THEN 0 ELSE x END) AS f FROM v)"


@query(
    f"WITH {_VECTORS}, {_CUT_VECTORS}, b AS (SELECT a.doc, a.vec_id, greatest(max(list_dot_product(a.e, b.f)), -1) AS best FROM c a JOIN c b ON a.doc = b.doc GROUP BY 1, 2) "
    "SELECT doc, round(avg(best) * 100, 6) AS semantic_score, count(*) FILTER (best < 0.75) AS low_chunks FROM b GROUP BY doc"
)
def semantic_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the edited ones of its document; the edit blanks every seventh component, from another place in each vector."""
    v = chunk_vectors(spark, sf_dir).withColumnRenamed("vec_id", "chunk_idx")
    edit = F.transform("embedding", lambda x, i: F.when((F.col("chunk_idx") + i + 1) % 7 == 0, F.lit(0.0)).otherwise(x.cast("double")))
    found = scoring.semantic_recall(v, v.withColumn("embedding", edit), key="doc")
    return found.select("doc", F.round("semantic_score", 6).alias("semantic_score"), "low_chunks")


# Chunks.


@query(
    "WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r(doc_id, i, size, n) AS (SELECT doc_id, 1, "
    + TOKENS.format("l[1]") + ", 1 FROM p UNION ALL SELECT r.doc_id, i + 1, CASE WHEN size + " + TOKENS.format("l[i + 1]") + " <= 100 THEN size + " + TOKENS.format("l[i + 1]") + " ELSE " + TOKENS.format("l[i + 1]") + " END, CASE WHEN size + "
    + TOKENS.format("l[i + 1]") + " <= 100 THEN n ELSE n + 1 END FROM r JOIN p ON p.doc_id = r.doc_id WHERE i < len(l)) SELECT doc_id, CAST(max(n) AS BIGINT) AS chunks FROM r GROUP BY doc_id"
)
def chunk_paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("parts"))
    return chunking.paragraph_pack(docs, 100).select("doc_id", F.size("chunk_starts").cast("long").alias("chunks"))


@query()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(md_docs(spark, sf_dir), 400, chunking.overlap_for(400, 10))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("l", F.concat("role", F.lit(": "), "text"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.expr("array_join(transform(array_sort(collect_list(struct(turn, role, text, l))), x -> x.l), '\\n')")).alias("digest"))


# Orchestration.


def _mode(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = md_docs(spark, sf_dir).withColumn("original_content", F.col("content"))
        return passes.report(passes.run(_cleaned(docs), passes.Pipeline.mode(name))).drop("duration_s")

    return run


for _name in passes.MODES:
    QUERIES[f"mode_{_name}"] = _mode(_name)


@query()
def pipeline_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = md_docs(spark, sf_dir).withColumn("original", F.col("content"))
    done = cut(passes.run(docs, passes.Pipeline(passes.V2_ORDER)).select("doc_id", "original", F.col("content").alias("optimized")))
    return scoring.rollback(scoring.validate(done)).select("doc_id", "semantic", "structure", "equation", "token_reduction", "passed", F.md5("output").alias("digest"))


@query(WITH + "SELECT doc_id, md5(content) AS digest, true AS same FROM md")
def equation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = md_docs(spark, sf_dir).withColumn("original", F.col("content"))
    done = passes.run(docs, passes.Pipeline(("equation_extraction", "equation_restoration")))
    return done.select("doc_id", digest("content"), (F.col("content") == F.col("original")).alias("same"))


@query()
def research_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = md_docs(spark, sf_dir)
    out = None
    for name in research.PROFILES:
        part = research.research(docs, name).select("doc_id", F.lit(name).alias("profile"), "passes_applied", "reduction", F.md5("content").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


@query(WITH + SECTIONS + r"SELECT m.doc_id, 'Doc ' || m.doc_id AS title, (SELECT count(*) FROM sec WHERE sec.doc_id = m.doc_id AND regexp_matches(first, '^#{1,6}\s+\S') AND regexp_matches(substr(body, length(first) + 1), '\S')) AS sections, (SELECT string_agg(trim(regexp_extract(first, '^#{1,6}\s+(.*)$', 1)), ' / ' ORDER BY sec_idx) FROM sec WHERE sec.doc_id = m.doc_id AND regexp_matches(first, '^#{1,6}\s+\S') AND regexp_matches(substr(body, length(first) + 1), '\S')) AS titles FROM md m")
def rag_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = research.structure_of(md_docs(spark, sf_dir))
    return found.select("doc_id", F.col("structure.title").alias("title"), F.size("structure.sections").cast("long").alias("sections"), F.array_join(F.transform("structure.sections", lambda s: s["title"]), " / ").alias("titles"))


# Sources, sinks, registries.


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.pages_to_markdown(table(spark, sf_dir, "pages"))


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS GROUP BY event_type")
def ttl_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("ts", "uploaded_at")
    newest = events.agg(F.max("uploaded_at").alias("newest"))
    return sinks.evict(events.crossJoin(F.broadcast(newest)), "newest").groupBy("event_type").agg(F.count("*").alias("kept"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def newest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return sinks.newest(events, "user_id", "at").select("user_id", "event_id", "ts")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, " + TOKENS.format("text") + r" AS tokens, CASE WHEN length(text) >= 1024 THEN CAST(round(length(text) / 1024.0, 1) AS VARCHAR) || ' KB' ELSE printf('%d B', length(text)) END AS size_text FROM documents")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return sinks.stats(docs).select("doc_id", "chars", "tokens", "size_text")


@query("SELECT regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[.]([a-z]+)$', 1) AS ext, count(*) AS n, count(*) FILTER (regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[.]([a-z]+)$', 1) IN ('html', 'htm')) AS supported FROM pages GROUP BY 1")
def page_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract(path, "[.]([a-z]+)$", 1).alias("ext"))
    return rows.groupBy("ext").agg(F.count("*").alias("n"), F.count_if(F.col("ext").isin("html", "htm")).alias("supported"))


@query("SELECT item_id, length(text) < 80 AS needs_ocr FROM benchmark")
def ocr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", files.needs_ocr(F.lit("x.pdf"), F.col("text")).alias("needs_ocr"))
