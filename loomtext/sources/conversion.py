"""From files to optimised Markdown: route, extract, read images, optimise, measure, in one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import native
from ..plans import passes
from . import files as S

#: What is done about images inside of documents: nothing, those of use, or all.
OCR_MODES = ("disabled", "smart", "aggressive")
Extract = Callable[[str, bytes], str]


def saved_name(name: Column) -> Column:
    """The name under which an upload is kept: 32 random hex digits and the file's own extension, lower case."""
    kind = T.suffix(name)
    return F.concat(F.regexp_replace(F.uuid(), "-", ""), F.when(kind != "", F.concat(F.lit("."), kind)).otherwise(""))


def saved(uploads: DataFrame) -> DataFrame:
    """uploads (name, data, ...) with saved_name; a caller's writer puts data there."""
    return uploads.withColumn("saved_name", saved_name(F.col("name")))


def extracted(files: DataFrame, general: Extract = S.to_text, research: Extract | None = None) -> DataFrame:
    """files (file_id, name, data, document_type, extractor_override) -> file_id, name, markdown, extractor, success, error.

    Research papers go to the research extractor, if there is one, and from it to the general one where it fails. Missing
    columns document_type and extractor_override count as null.
    """
    missing = [c for c in ("document_type", "extractor_override") if c not in files.columns]
    typed = files.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else files
    wanted = typed.withColumn("route", S.route(F.col("document_type"), F.col("extractor_override")))
    plain = S.convert(wanted.filter("route = 'general'"), extract=general)
    papers = S.convert(wanted.filter("route = 'research'"), extract=research or general, fallback=general if research else None)
    named = papers.withColumn("extractor", F.when(F.lit(research is None), "general").when(F.col("extractor") == "general", "research").otherwise("research->general"))
    return plain.unionByName(named)


def converted(files: DataFrame, read: Callable[[bytes], str] | None = None, ocr_mode: str = "smart", general: Extract = S.to_text, research: Extract | None = None) -> DataFrame:
    """extracted() with text from images, and the statistics of the Markdown.

    read turns an image into text. A file that has hardly any text, or is an image, is read as a whole; images
    inside of other documents are appended by ocr_mode. Columns ocr_used and n_images tell what was done; a file that failed has
    success false, an error, and no Markdown.
    """
    if ocr_mode not in OCR_MODES:
        raise ValueError(f"ocr_mode must be one of {', '.join(OCR_MODES)}")
    done = extracted(files, general, research)
    if read is not None and ocr_mode != "disabled":
        scans = files.join(done.filter(S.needs_ocr(F.col("name"), F.col("markdown"))).select("file_id"), "file_id", "left_semi")
        whole = S.whole_ocr(scans, read).filter(T.strip(F.col("markdown")) != "").select("file_id", F.col("markdown").alias("scan"))
        done = done.join(whole, "file_id", "left")
        inside = S.images(files.filter(~T.suffix(F.col("name")).isin(*P.IMAGE_EXTENSIONS)).join(whole.select("file_id"), "file_id", "left_anti"))
        texts = S.ocr(inside, read, smart=ocr_mode == "smart")
        counts = texts.groupBy("file_id").agg(F.count("*").alias("n_images"))
        merged = S.merge_ocr(done.filter("scan is null").select("file_id", "markdown"), texts).withColumnRenamed("markdown", "merged")
        done = done.join(merged, "file_id", "left").join(counts, "file_id", "left")
        done = done.select(
            "file_id", "name", F.coalesce("scan", "merged", "markdown").alias("markdown"), "extractor", (F.col("success") | F.col("scan").isNotNull()).alias("success"),
            F.when(F.col("scan").isNull(), F.col("error")).alias("error"), F.col("scan").isNotNull().alias("ocr_used"), F.coalesce("n_images", F.lit(0)).cast("long").alias("n_images"),
        )
    else:
        done = done.withColumns({"ocr_used": F.lit(False), "n_images": F.lit(0).cast("long")})
    text = F.when(F.col("success"), F.coalesce("markdown", F.lit(""))).otherwise("")
    done = done.withColumn("markdown", text)
    t = F.col("markdown")
    return done.withColumns({"char_count": F.length(t).cast("long"), "word_count": T.words(t), "token_estimate": T.tokens(t)})


def end_to_end(files: DataFrame, mode: str = "balanced", **options) -> DataFrame:
    """converted() with optimized_markdown, tokens_saved and percent_saved: base cleaner and the passes of a mode.

    A file that failed has an empty edit. Null and unknown modes count as "balanced".
    """
    done = converted(files, **options).withColumn("content", F.col("markdown"))
    for step in native.base_clean(F.col("content")):
        done = done.withColumn("content", step(F.col("content")))
    edited = passes.run(done, passes.Pipeline.mode(mode)).drop("eq_map", "history").withColumnRenamed("content", "optimized_markdown")
    before, after = F.col("token_estimate"), T.tokens(F.col("optimized_markdown"))
    saved_tokens = F.greatest(before - after, F.lit(0).cast("long"))
    return edited.withColumns({"tokens_saved": saved_tokens, "percent_saved": F.when(before > 0, F.round(saved_tokens * 100.0 / before, 1)).otherwise(0.0)})


def batch(files: DataFrame, mode: str = "balanced", most: int = 20, **options) -> DataFrame:
    """end_to_end() of 1 to ``most`` files, each with its place; more or none raise."""
    n = files.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a batch has 1 to {most} files")
    return end_to_end(files, mode, **options)
