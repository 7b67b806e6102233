"""What a service around the passes needs: settings files, discovery, runs with scores, reports, capability flags."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import native, scoring
from . import passes


def from_yaml(path: str) -> passes.Pipeline:
    """A pipeline from a settings file: a mapping, as Pipeline.of takes it. Needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("settings files need a YAML library") from e
    with open(path, encoding="utf-8") as file:
        config = yaml.safe_load(file) or {}
    if not isinstance(config, dict):
        raise passes.PipelineConfigError("a settings file must hold a mapping")
    return passes.Pipeline.of(config)


def discover(package: str) -> list[str]:
    """Import all modules of a package but those that begin with "_", so that they register their passes; gives the new passes' names."""
    before = set(passes.REGISTRY)
    found = importlib.import_module(package)
    for module in pkgutil.iter_modules(found.__path__):
        if not module.name.startswith("_"):
            importlib.import_module(f"{package}.{module.name}")
    return sorted(set(passes.REGISTRY) - before)


def health() -> dict:
    """Liveness, what the engine can do here, and how tokens are estimated."""
    have = lambda name: find_spec(name) is not None
    return {
        "status": "ok", "modes": sorted(passes.MODES), "formats": sorted(P.EXTENSIONS), "token_backend": "characters / 4",
        "image_library": have("PIL"), "yaml_library": have("yaml"),
    }


def chunk_source(optimized: Column, raw: Column, use_optimized: Column | bool = True) -> tuple[Column, Column]:
    """The text that is cut into chunks, and which it is: the edited one if it is asked for and not empty, else the raw one."""
    wanted = use_optimized if isinstance(use_optimized, Column) else F.lit(use_optimized)
    edited = F.coalesce(wanted & (F.coalesce(optimized, F.lit("")) != ""), F.lit(False))
    return F.when(edited, optimized).otherwise(F.coalesce(raw, F.lit(""))), F.when(edited, "optimized").otherwise("raw")


def cleaned(docs: DataFrame, content: str = "content") -> DataFrame:
    """docs after the base cleaner."""
    for step in native.base_clean(F.col(content)):
        docs = docs.withColumn(content, step(F.col(content)))
    return docs


def token_stats(before: Column, after: Column) -> dict[str, Column]:
    """Tokens of two texts, those saved (0 at least), and their share in percent with one decimal."""
    a, b = T.tokens(F.coalesce(before, F.lit(""))), T.tokens(F.coalesce(after, F.lit("")))
    saved = F.greatest(a - b, F.lit(0).cast("long"))
    return {"original_tokens": a, "optimized_tokens": b, "tokens_saved": saved, "percent_saved": F.when(a > 0, F.round(saved * 100.0 / a, 1)).otherwise(0.0)}


def run(docs: DataFrame, mode: str = "balanced", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs (doc_id, content) -> doc_id, optimized, token statistics and preservation scores.

    The base cleaner, the passes of a mode, then both measures against the text as it came. cut may cut the lineage
    between the edits and the measures.
    """
    began = docs.select("doc_id", "content", F.col("content").alias("original"))
    done = cut(passes.run(cleaned(began), passes.Pipeline.mode(mode)).select("doc_id", "original", F.col("content").alias("optimized")))
    counted = done.withColumns(token_stats(F.col("original"), F.col("optimized")))
    return counted.drop("original").join(scoring.score(done), "doc_id")


def v2_report(docs: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df, thresholds: dict[str, float] = scoring.THRESHOLDS) -> DataFrame:
    """docs (doc_id, content) -> doc_id, output, and a report struct of thirteen fields, after validation and roll-back.

    The times of passes are in totalRuntimeMs and passMetrics.runtime_ms alone; column edits have none.
    """
    began = docs.select("doc_id", "content", F.col("content").alias("original"))
    done = cut(passes.run(began, passes.Pipeline(passes.V2_ORDER)).select("doc_id", "original", F.col("content").alias("optimized"), "history"))
    judged = scoring.rollback(scoring.validate(done, thresholds=thresholds))
    before, after = T.tokens(F.coalesce("original", F.lit(""))), T.tokens(F.coalesce("output", F.lit("")))
    of = lambda name, metric: F.element_at(F.filter("history", lambda h: h["pass_name"] == name)[0]["metrics"], metric)
    tables = F.coalesce(of("semantic_table_transform", "rewritten"), of("table_compression", "rewritten"), F.lit(0).cast("long"))
    timed = lambda h: F.round(F.coalesce(h["duration_s"], F.lit(0.0)) * 1000, 2)
    metrics = F.transform("history", lambda h: F.struct(
        h["pass_name"].alias("name"), timed(h).alias("runtime_ms"), h["tokens_before"].alias("tokens_before"), h["tokens_after"].alias("tokens_after"),
        (h["tokens_before"] - h["tokens_after"]).alias("tokens_saved"), h["metrics"].alias("custom_metrics"), h["error"].isNotNull().alias("skipped"),
    ))
    report = F.struct(
        before.alias("originalTokens"), after.alias("optimizedTokens"), F.when(before > 0, F.round((before - after) * 100.0 / before, 2)).otherwise(0.0).alias("reductionPercent"),
        F.round("semantic", 4).alias("semanticScore"), F.round("structure", 4).alias("structureScore"), F.round("equation", 4).alias("equationScore"), (F.col("equation") >= 1.0).alias("equationsPreserved"),
        tables.alias("tablesTransformed"), F.col("warnings"), F.col("passed").alias("passedValidation"), (~F.col("passed")).alias("rolledBack"),
        F.aggregate("history", F.lit(0.0), lambda s, h: s + timed(h)).alias("totalRuntimeMs"), metrics.alias("passMetrics"),
    )
    return judged.select("doc_id", "output", report.alias("report"))
