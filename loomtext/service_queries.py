"""Queries of what surrounds the passes: sources, sinks, registries, scores, reports. Registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog as C
from .catalog import TOKENS, lit, pairs, query
from .functions import patterns as P
from .functions import text as T
from .operators import scoring
from .plans import passes, service
from .plans.corpus import md_docs
from .session import cut, table
from .sources import conversion, files, sinks
from .streaming import ingest

# Shared primitives.


@query(
    r"WITH t AS (SELECT doc_id, translate(text, 'xyz', chr(13) || chr(11) || chr(8232)) AS t FROM documents), p AS (SELECT doc_id, regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM t) "
    "SELECT doc_id, CAST(len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM p"
)
def any_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.translate("text", "xyz", "\r\x0b\u2028")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines_any(t)).cast("long").alias("n"))


@query(
    r"WITH f AS (SELECT page_id, split_part(split_part(url, '?', 1), '/', -1) AS name, length(html) / 10.0 AS s FROM pages) SELECT page_id, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS suffix, regexp_replace(name, '\.[^.]+$', '') AS stem, "
    "CASE WHEN s < 1 THEN printf('%.0f ms', s * 1000) ELSE printf('%.1f s', s) END AS took FROM f"
)
def display_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/", -1), -1)
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), (F.length("html") / 10.0).alias("s"))
    return rows.select("page_id", T.suffix(F.col("name")).alias("suffix"), T.stem(F.col("name")).alias("stem"), T.seconds_text(F.col("s")).alias("took"))


# Sources.

_ALLOWED = ", ".join(lit(x) for x in P.EXTENSIONS)


@query(
    r"WITH f AS (SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '/', -1), '\.([^.]+)$', 1)) AS kind FROM pages) "
    f"SELECT page_id, kind IN ({_ALLOWED}) AS supported, 32 + CASE WHEN kind <> '' THEN 1 + length(kind) ELSE 0 END AS saved_length, true AS well_formed FROM f"
)
def saved_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names uploads are kept under are random: their shape and length are compared."""
    name = F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/", -1), -1)
    rows = conversion.saved(table(spark, sf_dir, "pages").select("page_id", name.alias("name")))
    return rows.select("page_id", files.supported(F.col("name")).alias("supported"), F.length("saved_name").cast("long").alias("saved_length"), F.col("saved_name").rlike(r"^[0-9a-f]{32}([.][^.]+)?$").alias("well_formed"))


@query(
    "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'research_paper' WHEN doc_id % 3 = 1 THEN 'general_document' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'research' WHEN 2 THEN 'unknown' END AS override FROM documents) "
    "SELECT doc_id, CASE WHEN override IN ('general', 'research') THEN override WHEN kind = 'research_paper' THEN 'research' ELSE 'general' END AS extractor FROM t"
)
def extractor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case when doc_id % 3 = 0 then 'research_paper' when doc_id % 3 = 1 then 'general_document' end")
    override = F.expr("case doc_id % 4 when 0 then 'general' when 1 then 'research' when 2 then 'unknown' end")
    return table(spark, sf_dir, "documents").select("doc_id", files.route(kind, override).alias("extractor"))


@query("SELECT l_orderkey, l_linenumber, w * h >= 50000 AND w / h BETWEEN 0.15 AND 8 AS useful FROM (SELECT l_orderkey, l_linenumber, l_quantity * 40 AS w, l_linenumber * 90 AS h FROM lineitem)")
def image_size_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 40).alias("w"), (F.col("l_linenumber") * 90).alias("h"))
    return rows.select("l_orderkey", "l_linenumber", files.useful_size(F.col("w"), F.col("h")).alias("useful"))


_IMAGE_TEXT = "CASE item_id % 4 WHEN 0 THEN left(text, 50) WHEN 1 THEN replace(text, ' ', chr(10)) WHEN 2 THEN text || ' 12.3456 77.0012 1.999 100.123' ELSE text END"


@query(
    rf"""WITH t AS (SELECT item_id, regexp_replace({_IMAGE_TEXT}, '^\s+|\s+$', '', 'g') AS t FROM benchmark), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S'))) AS rows FROM t),
    f AS (SELECT *, len(w) < 5 AND length(t) < 60 AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) > 0.5 * len(w) AND NOT regexp_matches(t, '[.,;:!?]') AS logo, rows > 15 AND len(w) / greatest(rows, 1) < 3 AS sparse,
    coalesce(list_max(list_transform(list_distinct(list_filter(w, lambda x: length(x) > 2)), lambda x: len(list_filter(w, lambda y: y = x)))), 0) > 4 AS often, len(regexp_extract_all(t, '\b\d{{1,3}}\.\d{{3,}}\b')) > 3 AS places FROM w)
    SELECT item_id, length(t) >= 40 AND NOT logo AND NOT sparse AND NOT often AND NOT places AS useful FROM f"""
)
def image_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_IMAGE_TEXT.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "benchmark").select("item_id", files.useful_ocr(text).alias("useful"))


@query(
    "WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM conversations) SELECT conv_id, md5('Body ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Embedded Image Content' || chr(10) || chr(10) || "
    "string_agg('### Extracted Image Text (Image ' || nth || ')' || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```', chr(10) || chr(10) ORDER BY nth)) AS digest FROM t GROUP BY conv_id"
)
def image_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    found = rows.select(F.col("conv_id").alias("file_id"), "nth", F.format_string("Image %d", "nth").alias("position"), "text")
    bodies = found.select("file_id").distinct().withColumn("markdown", F.concat(F.lit("Body "), F.col("file_id").cast("string")))
    return files.merge_ocr(bodies, found).select(F.col("file_id").alias("conv_id"), F.md5("markdown").alias("digest"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS members, CAST(length(text) - len(string_split(text, chr(10))) + 1 AS BIGINT) AS chars FROM documents")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, packed as numbered files and read again from the archive."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("chunk_idx", "chunk"))
    packed = sinks.zip_chunks(lines).select(F.col("doc_id").cast("string").alias("file_id"), F.col("archive").alias("data"))
    found = files.members(packed, most_members=1 << 20).filter("error is null")
    return found.groupBy(F.col("file_id").cast("long").alias("doc_id")).agg(F.count("*").alias("members"), F.sum(F.length(F.decode("data", "utf-8"))).cast("long").alias("chars"))


@query()
def conversion_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages from file to optimised Markdown; every fifth is typed as a research paper, every seventh is of no known kind."""
    name = F.expr("concat('page', page_id, if(page_id % 7 = 0, '.bin', '.html'))")
    kind = F.expr("if(page_id % 5 = 0, 'research_paper', 'general_document')")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_id"), name.alias("name"), F.encode("html", "utf-8").alias("data"), kind.alias("document_type"))
    done = conversion.end_to_end(rows, "safe")
    return done.select("file_id", "extractor", "success", "ocr_used", "n_images", "char_count", "word_count", "token_estimate", "tokens_saved", "percent_saved", F.md5("optimized_markdown").alias("digest"))


# Chunks.


@query(
    "WITH t AS (SELECT doc_id, text AS raw, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE left(text, 100) END AS edited, doc_id % 3 <> 0 AS wanted FROM documents) "
    "SELECT doc_id, md5(CASE WHEN wanted AND coalesce(edited, '') <> '' THEN edited ELSE raw END) AS digest, CASE WHEN wanted AND coalesce(edited, '') <> '' THEN 'optimized' ELSE 'raw' END AS source FROM t"
)
def chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.expr("case doc_id % 4 when 0 then '' when 1 then null else left(text, 100) end")
    text, source = service.chunk_source(edited, F.col("text"), F.expr("doc_id % 3 <> 0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("digest"), source.alias("source"))


# Scores.

_ALL_PAIRS = C.PAIRS.replace("pr AS", "p0 AS") + (
    ", pr AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN ' ' ELSE original END AS original, CASE WHEN doc_id % 20 = 1 THEN '' WHEN doc_id % 20 = 2 THEN original ELSE optimized END AS optimized FROM p0) "
)


def _driver_sql() -> str:
    fixed = "CASE WHEN trim(original) = '' THEN 100.0 WHEN trim(optimized) = '' THEN 0.0 WHEN original = optimized THEN 100.0 END"
    return (
        C._SCORES.replace(C.PAIRS, _ALL_PAIRS) + C._BOW
        + f", o AS (SELECT pr.doc_id, {fixed} AS fixed, CASE WHEN trim(original) = '' OR trim(optimized) = '' THEN 'trivial' WHEN original = optimized THEN 'exact' ELSE 'bow' END AS method, coalesce(bow, 0) * 100 AS sem, CAST({C._CONTEXT} AS DOUBLE) AS ctx FROM pr JOIN s USING (doc_id) LEFT JOIN bw USING (doc_id)) "
        "SELECT doc_id, round(coalesce(fixed, sem), 2) AS semantic_preservation, round(100 - coalesce(fixed, sem), 2) AS semantic_loss, round(coalesce(fixed, ctx), 2) AS context_preservation, "
        "round(coalesce(fixed, CASE WHEN sem + ctx = 0 THEN 0 ELSE 2 * sem * ctx / (sem + ctx) END), 2) AS overall_preservation, method FROM o"
    )


@query(_driver_sql())
def score_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edit; of twenty one original is blank, one edit is empty, one is the same."""
    original = F.when(F.col("doc_id") % 20 == 0, " ").otherwise(F.col("original"))
    optimized = F.when(F.col("doc_id") % 20 == 1, "").when(F.col("doc_id") % 20 == 2, F.col("original")).otherwise(F.col("optimized"))
    rows = pairs(spark, sf_dir).select("doc_id", original.alias("original"), optimized.alias("optimized"))
    return scoring.score(rows).drop("issues")


@query(
    "WITH t AS (SELECT doc_id, 20 * length(text) AS chars, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, chars, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS chunk_idx, len(l) AS n FROM t), "
    "e AS (SELECT *, greatest(1, floor(n * 0.2))::BIGINT AS edge, chars > 200000 AND n > 20 AS large FROM w), m AS (SELECT *, chunk_idx + 1 > edge AND chunk_idx + 1 <= n - edge AS mid, CASE WHEN md5_number_upper(chunk) >= 9223372036854775808 THEN md5_number_upper(chunk)::HUGEINT - 18446744073709551616 ELSE md5_number_upper(chunk)::HUGEINT END AS h FROM e), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mid ORDER BY h, chunk_idx) AS place FROM m), k AS (SELECT * FROM p WHERE NOT large OR NOT mid OR place <= greatest(1, floor((n - 2 * edge) * 0.3))), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY chunk_idx) AS again FROM k) SELECT doc_id, count(*) AS windows, CAST(sum(chunk_idx) AS BIGINT) AS places FROM a WHERE NOT large OR again = 1 GROUP BY doc_id"
)
def window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for windows, and a document counts as twenty times as long as it is."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (20 * F.length("text")).alias("chars"), F.posexplode(T.lines(F.col("text"))).alias("chunk_idx", "chunk"))
    return scoring.sampled(rows).groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum("chunk_idx").alias("places"))


@query("SELECT doc_id, count(*) AS chunks, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a vector each, equal lines embedded once; the vector of a line is its length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("chunk"))
    found = scoring.embedded(rows, lambda texts: [[float(len(t))] for t in texts])
    return found.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.col("embedding")[0]).cast("long").alias("chars"))


# Reports.


@query()
def service_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = service.run(md_docs(spark, sf_dir), "balanced", cut)
    return done.select("doc_id", F.md5("optimized").alias("digest"), "original_tokens", "optimized_tokens", "tokens_saved", "percent_saved", "semantic_preservation", "context_preservation", "overall_preservation", "method")


@query()
def v2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report without its times, which differ from run to run."""
    done = service.v2_report(md_docs(spark, sf_dir), cut)
    r = F.col("report").dropFields("totalRuntimeMs", "passMetrics")
    return done.select("doc_id", F.md5("output").alias("digest"), r.alias("report")).select("doc_id", "digest", "report.*")


@query(f"SELECT doc_id, {TOKENS.format('text')} AS original_tokens, {TOKENS.format('left(text, length(text) // 3)')} AS optimized_tokens, greatest({TOKENS.format('text')} - {TOKENS.format('left(text, length(text) // 3)')}, 0) AS tokens_saved, CASE WHEN text = '' THEN 0.0 ELSE round(greatest({TOKENS.format('text')} - {TOKENS.format('left(text, length(text) // 3)')}, 0) * 100.0 / {TOKENS.format('text')}, 1) END AS percent_saved FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in service.token_stats(F.col("text"), F.expr("left(text, cast(length(text) div 3 as int))")).items()])


@query(
    f"WITH r AS (SELECT doc_id, {TOKENS.format('text')} AS a, {TOKENS.format('left(text, length(text) // 3)')} AS b FROM documents) "
    "SELECT doc_id, '4 passes executed, ' || (doc_id % 2) || ' failed | ' || format('{:,}', a) || ' → ' || format('{:,}', b) || ' tokens (' || printf('%.1f', round((a - b) * 100.0 / a, 1)) || '% saved)' AS summary FROM r"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = service.token_stats(F.col("text"), F.expr("left(text, cast(length(text) div 3 as int))"))
    rows = docs.select("doc_id", F.lit(4).cast("long").alias("passes"), (F.col("doc_id") % 2).alias("errors"), measured["original_tokens"].alias("original_tokens"), measured["optimized_tokens"].alias("final_tokens"), measured["percent_saved"].alias("percent_saved"))
    return sinks.summary(rows)


_REPORT = "'# Optimization report' || chr(10) || chr(10) || '- Passes: 1' || chr(10) || chr(10) || '| Pass | Before | After | Saved |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| citation_removal | ' || tokens_before || ' | ' || tokens_after || ' | ' || (tokens_before - tokens_after) || ' |'"


@query(f"SELECT doc_id, {_REPORT} AS report FROM ({C.ORACLE['pass_citation_removal']})")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown_report(passes.run(md_docs(spark, sf_dir), passes.Pipeline(("citation_removal",))))


@query("SELECT doc_id, CAST((text = '')::INT + (length(text) > 500)::INT + (doc_id % 3 = 0)::INT AS BIGINT) AS n FROM documents")
def issue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = lambda when, severity: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit("m").alias("message")))
    issues = F.filter(F.array(issue(F.length("text") == 0, "danger"), issue(F.length("text") > 500, "warning"), issue(F.lit(True), "info"), issue(F.col("doc_id") % 3 == 0, "warning")), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "documents").select("doc_id", issues.alias("issues"))
    return rows.select("doc_id", F.size(sinks.significant()).cast("long").alias("n"))


@query(f"SELECT 'ok' AS status, 'characters / 4' AS token_backend, '{','.join(sorted(passes.MODES))}' AS modes, {len(P.EXTENSIONS)} AS formats")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = service.health()
    return spark.range(1).select(F.lit(h["status"]).alias("status"), F.lit(h["token_backend"]).alias("token_backend"), F.lit(",".join(h["modes"])).alias("modes"), F.lit(len(h["formats"])).alias("formats"))


# Sinks and registries.


@query("SELECT 'f' || event_id AS path FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS")
def orphan_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    rows = events.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modificationTime")).withColumn("newest", newest.scalar())
    return sinks.orphans(rows, "newest")


@query(
    "SELECT source AS zip_name, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth, 'd' || doc_id || '.md' AS name, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN doc_id % 3 <> 0 THEN left(text, 50) END AS markdown, "
    "CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN left(text, 10) ELSE left(text, 50) END END AS optimized, CASE WHEN doc_id % 3 = 0 THEN 'failed' END AS error FROM documents"
)
def zip_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr("struct(doc_id, concat('d', doc_id, '.md') as filename, doc_id % 3 <> 0 as success, left(text, 50) as markdown, if(doc_id % 2 = 0, left(text, 10), '') as optimized_markdown, cast(null as string) as error)")
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("zip_name")).agg(F.array_sort(F.collect_list(one)).alias("files"))
    return sinks.expanded(rows).withColumn("nth", F.col("nth").cast("long"))


@query("SELECT count(*) AS total, count(*) FILTER (length(text) > 400) AS succeeded, count(*) FILTER (length(text) <= 400) AS failed FROM documents")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.batch_totals(table(spark, sf_dir, "documents").select((F.length("text") > 400).alias("success")))


@query("SELECT doc_id, doc_id % 3 = 0 AS skipped FROM documents")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    found, skipped = sinks.archive_of(docs.select("path", "doc_id"), docs.filter("doc_id % 3 <> 0").select("path", F.encode("text", "utf-8").alias("data")))
    return found.select("doc_id", F.lit(False).alias("skipped")).unionByName(skipped.select("doc_id", F.lit(True).alias("skipped")))


@query("SELECT doc_id FROM documents WHERE 'd' || doc_id NOT IN (SELECT 'd' || doc_id FROM labels)")
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    return sinks.new_files(table(spark, sf_dir, "documents").select("doc_id", name), table(spark, sf_dir, "labels").select(name)).select("doc_id")


@query("SELECT event_id AS file_id, ts AS at FROM events ORDER BY ts DESC, event_id LIMIT 30")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thirty: a top-k report."""
    return sinks.recent(table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.col("ts").alias("at")))


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate over a table at rest, where no row is late."""
    found = ingest.arrivals(table(spark, sf_dir, "events"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
