"""Preservation scores of an edited text against its original: column expressions on (original, optimized)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

WEIGHTS = {"section": 0.25, "table": 0.20, "numeric": 0.20, "code": 0.10, "image": 0.10, "entity": 0.15}


def headings(text: Column) -> Column:
    """Distinct lower-case titles of levels 1 to 3."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?dm)^#{1,3}\s+(.+)$"), F.lit(1)), lambda x: F.lower(T.strip(x))))


def table_rows(text: Column) -> Column:
    ok = lambda x: T.strip(x).startswith("|") & T.strip(x).endswith("|") & (F.length(T.strip(x)) > 2)
    return F.size(F.filter(T.lines(text), ok))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + P.NUMBER), F.lit(0)))


def entities(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for p in P.ENTITIES]
    return F.array_distinct(F.concat(*found))


def _kept(before: Column, after: Column) -> tuple[Column, Column]:
    missing = F.size(F.array_except(before, after))
    return F.when(F.size(before) == 0, 100.0).otherwise((F.size(before) - missing) * 100.0 / F.size(before)), missing


def _ratio(before: Column, after: Column) -> Column:
    return F.when((before == 0) | (after >= before), 100.0).otherwise(after * 100.0 / before)


def scores(pairs: DataFrame, original: str = "original", optimized: str = "optimized") -> DataFrame:
    """pairs with the six sub-scores, ``context_score`` and ``issues`` (severity, message); all their columns stay."""
    o, n = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(optimized), F.lit(""))
    c = {k: T.free_name(pairs, k) for k in ("oh", "nh", "on", "nn", "oe", "ne", "ot", "nt", "oc", "nc", "oi", "ni")}
    big = F.filter(numbers(o), lambda x: (F.length(x) >= 3) | x.rlike(r"\p{L}"))
    df = pairs.withColumns({
        c["oh"]: headings(o), c["nh"]: headings(n), c["on"]: big, c["nn"]: numbers(n), c["oe"]: entities(o), c["ne"]: entities(n),
        c["ot"]: table_rows(o), c["nt"]: table_rows(n), c["oc"]: F.expr(f"regexp_count(coalesce(`{original}`, ''), '```') div 2"), c["nc"]: F.expr(f"regexp_count(coalesce(`{optimized}`, ''), '```') div 2"),
        c["oi"]: F.regexp_count(o, F.lit(P.IMAGE)), c["ni"]: F.regexp_count(n, F.lit(P.IMAGE)),
    })
    section, lost_h = _kept(F.col(c["oh"]), F.col(c["nh"]))
    numeric, lost_n = _kept(F.col(c["on"]), F.col(c["nn"]))
    entity, lost_e = _kept(F.col(c["oe"]), F.col(c["ne"]))
    df = df.withColumns({
        "section_score": section, "table_score": _ratio(F.col(c["ot"]), F.col(c["nt"])), "numeric_score": numeric,
        "code_score": _ratio(F.col(c["oc"]), F.col(c["nc"])), "image_score": _ratio(F.col(c["oi"]), F.col(c["ni"])), "entity_score": entity,
    })
    issue = lambda when, severity, text: F.when(when, F.struct(severity.alias("severity"), text.alias("message")))
    plain = lambda s: F.lit(s)
    issues = F.array(
        issue(F.size(c["oh"]) == 0, plain("info"), plain("no headings")),
        issue(lost_h > 0, F.when(lost_h <= 3, "warning").otherwise("danger"), F.format_string("%d of %d sections missing", lost_h, F.size(c["oh"]))),
        issue(F.col("table_score") < 100, F.when(F.col("table_score") < 50, "danger").otherwise("warning"), F.format_string("table rows %d to %d", c["ot"], c["nt"])),
        issue(lost_n > 0, F.when(lost_n > F.size(c["on"]) * 0.3, "danger").otherwise("warning"), F.format_string("%d numbers missing", lost_n)),
        issue(F.col("code_score") < 100, plain("danger"), plain("code blocks removed")),
        issue(F.col("image_score") < 100, plain("warning"), plain("images removed")),
        issue(lost_e > F.size(c["oe"]) * 0.2, plain("warning"), F.format_string("%d entities missing", lost_e)),
    )
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("context_score", total).withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
    return df.drop(*c.values())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def bow_cosine(pairs: DataFrame, key: str = "doc_id", original: str = "original", optimized: str = "optimized") -> DataFrame:
    """(key, bow): cosine of the word counts, 0 where either has no words. One shuffle by key and word, one by key."""
    side = lambda c, i: pairs.select(key, F.explode(terms(F.coalesce(F.col(c), F.lit("")))).alias("term"), F.lit(i).alias("side"))
    counts = side(original, 0).unionByName(side(optimized, 1)).groupBy(key, "term").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("a"), F.sum("side").alias("b"))
    sums = counts.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    bow = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).otherwise(0.0)
    return pairs.select(key).distinct().join(sums, key, "left").select(key, F.coalesce(bow, F.lit(0.0)).alias("bow"))


def overall(semantic: Column, context: Column) -> Column:
    """Harmonic mean."""
    return F.when(semantic + context == 0, 0.0).otherwise(2 * semantic * context / (semantic + context))


def label(score: Column) -> Column:
    return F.when(score >= 98, "Excellent").when(score >= 95, "Good").when(score >= 90, "Moderate").otherwise("Significant Loss")


def sentence_windows(text: Column, size: int = 5, step: int = 3) -> Column:
    """Windows of sentences of more than 15 characters; without any, the first 1000 characters."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), T.strip), lambda s: F.length(s) > 15)
    windows = F.when(F.size(sentences) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(sentences), F.lit(1)), F.lit(step)), lambda i: F.array_join(F.slice(sentences, i, F.lit(size)), " ")))
    return F.coalesce(windows, F.when(T.strip(text) != "", F.array(F.substring(text, 1, 1000))).otherwise(F.array().cast("array<string>")))


def structure(original: Column, optimized: Column) -> Column:
    """Mean of heading, list, code and paragraph retention, each at most 1."""
    heads = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?dm)^(#{1,6}\s+.+)$"), F.lit(1)))
    items = lambda t: F.regexp_count(t, F.lit(r"(?dm)^\s*[-*+]\s+")) + F.regexp_count(t, F.lit(r"(?dm)^\s*\d+\.\s+"))
    code = lambda t: F.regexp_count(t, F.lit(r"```[\s\S]*?```"))
    paras = lambda t: F.size(F.filter(T.paragraphs(t), lambda x: T.strip(x) != ""))
    share = lambda a, b: F.when(a == 0, 1.0).otherwise(F.least(F.lit(1.0), b / a))
    kept = F.size(F.array_intersect(heads(original), heads(optimized)))
    return (share(F.size(heads(original)), kept) + share(items(original), items(optimized)) + share(code(original), code(optimized)) + share(paras(original), paras(optimized))) / 4


EQUATION_FORMS = (r"\$\$[\s\S]*?\$\$", r"(?<!\$)\$(?!\$)(?:[^$\n\\]|\\.)+\$(?!\$)", r"\\begin\{(?:equation\*?|align\*?|gather\*?|multline\*?|math)\}[\s\S]*?\\end\{(?:equation\*?|align\*?|gather\*?|multline\*?|math)\}", r"\\\[[\s\S]*?\\\]", r"\\\([\s\S]*?\\\)", r"\b\d+\.?\d*[eE][+-]?\d+\b")


def equations(original: Column, optimized: Column) -> Column:
    """Share of the original's equations that the edited text has word for word."""
    found = F.concat(*[F.regexp_extract_all(original, F.lit(p), F.lit(0)) for p in EQUATION_FORMS])
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(F.filter(found, lambda e: F.contains(optimized, e))) / F.size(found))


THRESHOLDS = {"semantic": 0.70, "structure": 0.50, "equation": 0.95, "reduction": 0.80}


def validate(pairs: DataFrame, key: str = "doc_id", original: str = "original", optimized: str = "optimized", thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """pairs with semantic, structure and equation scores, token_reduction, warnings, reasons and passed."""
    o, n = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(optimized), F.lit(""))
    blank = T.strip(o) == ""
    df = pairs.join(bow_cosine(pairs, key, original, optimized).withColumnRenamed("bow", "semantic"), key)
    cut = F.when(T.tokens(o) > 0, (T.tokens(o) - T.tokens(n)) / T.tokens(o)).otherwise(0.0)
    df = df.withColumns({
        "semantic": F.when(blank, 1.0).otherwise(F.col("semantic")), "structure": F.when(blank, 1.0).otherwise(structure(o, n)),
        "equation": F.when(blank, 1.0).otherwise(equations(o, n)), "token_reduction": F.when(blank, 0.0).otherwise(cut),
    })
    some = lambda *xs: F.filter(F.array(*[F.when(c, t) for c, t in xs]), lambda x: x.isNotNull())
    warnings = some((F.col("token_reduction") > 0.6, "high token reduction"), (F.col("semantic") < 0.8, "low semantic similarity"), (F.col("equation") < 1.0, "equations lost"), (F.col("structure") < 0.7, "low structure preservation"), ((T.strip(n) == "") & ~blank, "empty output"))
    reasons = some(*[(F.col(k) < thresholds[k], k) for k in ("semantic", "structure", "equation")], (F.col("token_reduction") > thresholds["reduction"], "reduction"))
    df = df.withColumns({"warnings": F.when(blank, F.array().cast("array<string>")).otherwise(warnings), "reasons": F.when(blank, F.array().cast("array<string>")).otherwise(reasons)})
    return df.withColumn("passed", F.size("reasons") == 0)


def rollback(validated: DataFrame, original: str = "original", optimized: str = "optimized") -> DataFrame:
    """The edited text where it passed, else the original."""
    return validated.withColumn("output", F.when(F.col("passed"), F.col(optimized)).otherwise(F.col(original)))


def semantic_recall(originals: DataFrame, edited: DataFrame, key: str = "doc_id", vector: str = "embedding", low: float = 0.75) -> DataFrame:
    """Mean over a document's original chunks of the greatest cosine to its edited chunks, in percent, and the number
    of chunks below ``low``. Both sides hold (key, chunk_idx, unit vector); pairs are formed within a document."""
    a, b = originals.select(key, "chunk_idx", F.col(vector).alias("x")), edited.select(key, F.col(vector).alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    best = a.join(b, key, "left").groupBy(key, "chunk_idx").agg(F.coalesce(F.max(dot), F.lit(0.0)).alias("best"))
    return best.groupBy(key).agg((F.avg("best") * 100).alias("semantic_score"), F.count_if(F.col("best") < low).alias("low_chunks"))


def score(pairs: DataFrame, recall: DataFrame | None = None, key: str = "doc_id", original: str = "original", optimized: str = "optimized") -> DataFrame:
    """pairs -> key, semantic_preservation, semantic_loss, context_preservation, overall_preservation, method, issues.

    An empty original scores 100, an empty edit 0, equal texts 100 ("exact"). Otherwise the semantic score is that of
    recall (key, semantic_score, low_chunks; see semantic_recall), or where it has none the cosine of word counts.
    """
    o, n = T.strip(F.coalesce(F.col(original), F.lit(""))), T.strip(F.coalesce(F.col(optimized), F.lit("")))
    method = F.when(o == "", "trivial").when(n == "", "trivial").when(o == n, "exact")
    fixed = F.when(o == "", 100.0).when(n == "", 0.0).when(o == n, 100.0)
    made = scores(pairs, original, optimized).select(key, method.alias("fixed_method"), fixed.alias("fixed"), F.col("context_score").cast("double").alias("context"), "issues")
    made = made.join(bow_cosine(pairs, key, original, optimized), key)
    if recall is None:
        made = made.withColumns({"semantic_score": F.lit(None).cast("double"), "low_chunks": F.lit(0).cast("long")})
    else:
        made = made.join(recall.select(key, "semantic_score", "low_chunks"), key, "left")
    semantic = F.coalesce("fixed", "semantic_score", F.col("bow") * 100)
    context = F.coalesce("fixed", "context")
    low = F.filter(F.array(F.when(F.col("low_chunks") > 0, F.struct(F.lit("warning").alias("severity"), F.format_string("%d chunks may have lost content", "low_chunks").alias("message")))), lambda x: x.isNotNull())
    return made.select(
        key, F.round(semantic, 2).alias("semantic_preservation"), F.round(100 - semantic, 2).alias("semantic_loss"), F.round(context, 2).alias("context_preservation"),
        F.round(F.coalesce("fixed", overall(semantic, context)), 2).alias("overall_preservation"), F.coalesce("fixed_method", F.when(F.col("semantic_score").isNotNull(), "embeddings").otherwise("bow")).alias("method"),
        F.when(F.col("fixed").isNull(), F.concat("issues", low)).otherwise(F.array().cast("array<struct<severity:string,message:string>>")).alias("issues"),
    )


#: Characters and windows above which windows are sampled, and the shares of head and tail and of the middle.
LARGE_CHARS, LARGE_WINDOWS, ENDS, MIDDLE = 200_000, 20, 0.2, 0.3


def sampled(windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """windows (key, chunk_idx, chunk, chars) with the windows of large documents sampled; chars is the document's length.

    Of a document with more than LARGE_CHARS characters and LARGE_WINDOWS windows the first and the last fifth stay and three tenths
    of those between, those of the least hash of their text, and of equal windows the first.
    """
    by_doc = Window.partitionBy(key)
    rows = windows.withColumns({"n_windows": F.count("*").over(by_doc), "nth_window": F.row_number().over(by_doc.orderBy("chunk_idx"))})
    edge = F.greatest(F.lit(1), F.floor(F.col("n_windows") * ENDS)).cast("long")
    rows = rows.withColumn("in_middle", (F.col("nth_window") > edge) & (F.col("nth_window") <= F.col("n_windows") - edge))
    taken = F.greatest(F.lit(1), F.floor((F.col("n_windows") - 2 * edge) * MIDDLE))
    place = F.row_number().over(Window.partitionBy(key, "in_middle").orderBy(T.hash64(F.col("chunk")), "chunk_idx"))
    rows = rows.withColumn("large", (F.col("chars") > LARGE_CHARS) & (F.col("n_windows") > LARGE_WINDOWS)).withColumn("place", place)
    rows = rows.filter(~F.col("large") | ~F.col("in_middle") | (F.col("place") <= taken))
    again = F.row_number().over(Window.partitionBy(key, F.sha2("chunk", 256)).orderBy("chunk_idx"))
    return rows.withColumn("again", again).filter(~F.col("large") | (F.col("again") == 1)).select(*windows.columns)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], chunk: str = "chunk", vector: str = "embedding") -> DataFrame:
    """chunks with a vector each; equal chunks are embedded once, whatever documents they are in."""
    sha = T.free_name(chunks, "sha")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(embed(batch.column(1).to_pylist()), pa.list_(pa.float32()))], [sha, vector])

    marked = chunks.withColumn(sha, F.sha2(F.coalesce(F.col(chunk), F.lit("")), 256))
    once = marked.groupBy(sha).agg(F.first(F.coalesce(F.col(chunk), F.lit(""))).alias("text"))
    return marked.join(once.mapInArrow(work, f"`{sha}` string, `{vector}` array<float>"), sha).drop(sha)
