"""The registered passes, their parameters, and the executor that runs a list of them over a corpus.

A pass is either a list of column expressions or a function of one document. Runs of the latter share one trip
to the Python workers. Nothing is shuffled: a document is one row from the first pass to the last.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import documents as D
from ..operators import native as N
from ..session import small_batches


class OptimizerError(Exception):
    """Base of all errors of this module."""


class PassNotFoundError(OptimizerError):
    """No pass of that name."""


class DuplicatePassError(OptimizerError):
    """A pass of that name is there already."""


class PassConfigError(OptimizerError):
    """A parameter has no meaning."""


class PassExecutionError(OptimizerError):
    """A pass failed."""


class PipelineConfigError(OptimizerError):
    """A pipeline's settings have no meaning."""


@dataclass(frozen=True)
class Pass:
    """A pass: either ``steps`` (parameters -> column edits) or ``edit`` (text, parameters, kept equations -> text,
    kept equations, metrics). ``counts`` are the metrics of the former, ``details`` what is no counter, as JSON."""

    name: str
    description: str
    priority: int
    defaults: dict
    steps: Callable[[dict], list[Callable[[Column], Column]]] | None = None
    edit: Callable[[str, dict, dict], tuple[str, dict, dict]] | None = None
    checks: tuple[tuple[str, Callable[[dict], bool]], ...] = ()
    counts: Callable[[Column, dict], dict[str, Column]] = lambda t, p: {}
    details: Callable[[Column, dict], Column] = lambda t, p: F.lit(None).cast("string")

    def settings(self, given: dict | None) -> dict:
        """Defaults with what is given; unknown names and values without meaning raise."""
        unknown = set(given or {}) - set(self.defaults)
        if unknown:
            raise PassConfigError(f"{self.name}: unknown parameters {sorted(unknown)}")
        p = self.defaults | (given or {})
        for text, holds in self.checks:
            if not holds(p):
                raise PassConfigError(f"{self.name}: {text}")
        return p


REGISTRY: dict[str, Pass] = {}


def register(item: Pass, force: bool = False) -> Pass:
    if item.name in REGISTRY and not force:
        raise DuplicatePassError(item.name)
    REGISTRY[item.name] = item
    return item


def unregister(name: str) -> None:
    if REGISTRY.pop(name, None) is None:
        raise PassNotFoundError(name)


def get(name: str) -> Pass:
    if name not in REGISTRY:
        raise PassNotFoundError(name)
    return REGISTRY[name]


def _whole(name: str, least: int) -> tuple[str, Callable[[dict], bool]]:
    return f"{name} must be a whole number of at least {least}", lambda p: isinstance(p[name], int) and not isinstance(p[name], bool) and p[name] >= least


def _share(name: str) -> tuple[str, Callable[[dict], bool]]:
    return f"{name} must be above 0 and at most 1", lambda p: 0 < p[name] <= 1


def _one_of(name: str, *values: str) -> tuple[str, Callable[[dict], bool]]:
    return f"{name} must be one of {', '.join(values)}", lambda p: p[name] in values


def _plain(edit: Callable[[str, dict], D.Result]) -> Callable[[str, dict, dict], tuple[str, dict, dict]]:
    def run(text: str, p: dict, kept: dict) -> tuple[str, dict, dict]:
        new, metrics = edit(text, p)
        return new, kept, metrics

    return run


def _shield(text: str, p: dict, kept: dict) -> tuple[str, dict, dict]:
    kinds = {k: p[v] for k, v in {
        "latex_env": "detect_latex_env", "display_math": "detect_display_math", "bracket_display": "detect_display_math", "inline_math": "detect_inline_math",
        "paren_inline": "detect_inline_math", "latex_cmd": "detect_latex_commands", "sci_notation": "detect_sci_notation", "sub_super": "detect_sub_super",
    }.items()}
    new, found, counts = D.shield(text, kinds)
    return new, kept | found, counts


def _references(text: str, p: dict) -> D.Result:
    titles = {t.lower(): "references" for t in p["section_titles"]}
    return D.drop_sections(text, titles, frozenset(P.AFTER_REFERENCES) - set(titles), p["mode"], p["summary_template"], p["detect_ocr_headings"], p["detect_setext"], p["max_heading_length"], True)


def _boilerplate(text: str, p: dict) -> D.Result:
    groups = {k: v for k, v in P.BOILERPLATE_TITLES.items() if p["sections"].get(k, True)} | p["custom_titles"]
    titles = {t.lower(): g for g, ts in groups.items() for t in ts}
    return D.drop_sections(text, titles, frozenset(titles), p["mode"], p["summary_template"], p["detect_ocr_headings"], p["detect_setext"], p["max_heading_length"], False)


def _compress(text: str, p: dict) -> D.Result:
    if p["mode"] == "keep":
        return text, {}
    return D.rewrite_tables(text, p["min_rows"], p["max_columns"], p["preserve_scientific"], lambda h, b: D.compress_table(h, b, p["kv_separator"], p["col_separator"]))


def _transform(text: str, p: dict) -> D.Result:
    if p["mode"] == "keep":
        return text, {}
    return D.rewrite_tables(text, p["min_rows"], p["max_columns"], p["preserve_scientific"], lambda h, b: D.list_table(h, b, p["nested_multicolumn"]), p["repair_malformed"])


def _upper(text: str, p: dict) -> D.Result:
    return D.rx(rf"^(#{{1,6}})(\s+)(.+)$", D.re.M).sub(lambda m: m[1] + m[2] + m[3].upper() if len(m[1]) in p["heading_levels"] else m[0], text), {}


register(Pass("equation_extraction", "Replace equations with placeholders", 1,
              {"detect_latex_env": True, "detect_display_math": True, "detect_inline_math": True, "detect_latex_commands": True, "detect_sci_notation": True, "detect_sub_super": False}, edit=_shield))
register(Pass("ocr_cleanup", "Repair characters, spaces and line breaks", 5,
              {"remove_cid": True, "normalize_unicode": True, "fix_whitespace": True, "unwrap_lines": True, "fix_punctuation": True, "remove_control_chars": True, "normalize_quotes": False},
              steps=N.ocr_cleanup, counts=lambda t, p: N.ocr_counts(t)))
register(Pass("content_boilerplate", "Remove contents lists, certificates, evaluation sheets, page numbers, repeated lines", 12,
              {"remove_toc": True, "remove_certificates": True, "remove_eval_sheets": True, "remove_page_numbers": True, "remove_repeated_lines": True, "min_repeat_count": 3, "max_repeat_line_length": 80, "whitelist": []},
              steps=N.content_boilerplate, checks=(_whole("min_repeat_count", 2),)))
register(Pass("header_footer_detection", "Remove lines that recur at the head or foot of pages", 15,
              {"min_frequency_ratio": 0.5, "header_zone_lines": 5, "footer_zone_lines": 5, "min_pages": 3, "max_line_length": 200, "min_line_length": 2, "page_delimiter": None, "preserve_md_headings": True, "fuzzy_matching": True, "fuzzy_threshold": 0.85},
              edit=_plain(D.drop_page_lines), checks=(_share("min_frequency_ratio"), _share("fuzzy_threshold"), _whole("header_zone_lines", 1), _whole("footer_zone_lines", 1), _whole("min_pages", 1))))
register(Pass("reference_section_removal", "Remove or summarise reference sections", 20,
              {"mode": "remove", "section_titles": list(P.REFERENCE_TITLES), "summary_template": "[References removed: {count} entries]", "detect_ocr_headings": True, "detect_setext": True, "max_heading_length": 50},
              edit=_plain(_references), checks=(_one_of("mode", "remove", "summarize", "keep"), ("section_titles must be a list with titles", lambda p: isinstance(p["section_titles"], list) and bool(p["section_titles"])), _whole("max_heading_length", 1))))
register(Pass("boilerplate_section_removal", "Remove or summarise acknowledgements, funding and the like", 22,
              {"mode": "remove", "sections": {k: True for k in P.BOILERPLATE_TITLES}, "summary_template": "[{group} section removed]", "detect_ocr_headings": True, "detect_setext": True, "max_heading_length": 60, "custom_titles": {}},
              edit=_plain(_boilerplate), checks=(_one_of("mode", "remove", "summarize", "keep"), ("sections must map names to true or false", lambda p: isinstance(p["sections"], dict) and all(isinstance(v, bool) for v in p["sections"].values())), ("custom_titles must be a mapping", lambda p: isinstance(p["custom_titles"], dict)), _whole("max_heading_length", 1))))
register(Pass("citation_removal", "Remove inline citations", 25,
              {"mode": "remove", "placeholder": "[citation]", "detect_numeric": True, "detect_author_year": True, "protect_markdown_links": True, "protect_equations": True, "protect_code_blocks": True, "protect_footnotes": True, "merge_adjacent_placeholders": True},
              steps=N.citations, checks=(_one_of("mode", "remove", "replace_with_placeholder", "keep"), ("placeholder must not be empty", lambda p: bool(p["placeholder"]))),
              counts=N.citation_counts, details=N.citation_details))
register(Pass("global_paragraph_deduplication", "Remove paragraphs that repeat an earlier one", 30,
              {"mode": "normalized", "similarity_threshold": 0.85, "min_paragraph_length": 20, "preserve_headings": True, "preserve_code_blocks": True, "max_hamming_distance": 12},
              edit=_plain(D.dedup_paragraphs), checks=(_one_of("mode", "exact", "normalized", "fuzzy"), _share("similarity_threshold"), _whole("min_paragraph_length", 0), _whole("max_hamming_distance", 0))))
register(Pass("table_compression", "Write tables more briefly", 35, {"mode": "compress", "min_rows": 2, "max_columns": 10, "preserve_scientific": True, "kv_separator": "=", "col_separator": "|"},
              edit=_plain(_compress), checks=(_one_of("mode", "compress", "keep"), _whole("min_rows", 1), _whole("max_columns", 1))))
register(Pass("semantic_table_transform", "Write tables as lists", 36, {"mode": "transform", "min_rows": 1, "max_columns": 10, "preserve_scientific": True, "repair_malformed": True, "nested_multicolumn": True},
              edit=_plain(_transform), checks=(_one_of("mode", "transform", "keep"),)))
register(Pass("abbreviation_mining", "Replace frequent phrases by acronyms", 40,
              {"min_frequency": 3, "min_words": 2, "min_acronym_length": 2, "max_acronym_length": 6, "min_confidence": 0.3, "protect_headings": True, "protect_code": True, "intro_format": "{phrase} ({acronym})"},
              edit=_plain(D.abbreviate), checks=(_whole("min_frequency", 1), _whole("min_words", 2), ("intro_format must hold {phrase} and {acronym}", lambda p: "{phrase}" in p["intro_format"] and "{acronym}" in p["intro_format"]))))
register(Pass("semantic_deduplication", "Remove paragraphs close in the embedding", 45,
              {"embed": D.hashed_embedding, "similarity_threshold": 0.85, "min_paragraph_length": 30, "preserve_headings": True, "preserve_code_blocks": True, "batch_size": 32, "representative_strategy": "first"},
              edit=_plain(lambda text, p: D.dedup_semantic(text, p, p["embed"])), checks=(_share("similarity_threshold"), _one_of("representative_strategy", "first", "longest"), _whole("min_paragraph_length", 0), _whole("batch_size", 1))))
register(Pass("importance_aware", "Shorten sections by their importance", 50,
              {"tier1_action": "preserve", "tier2_action": "moderate", "tier3_action": "aggressive", "remove_tier3": False, "compress_citations_tier2": True, "compress_redundant_tier2": True},
              edit=_plain(D.by_importance), checks=tuple(_one_of(f"tier{k}_action", "preserve", "moderate", "aggressive") for k in (1, 2, 3))))
register(Pass("equation_restoration", "Put equations back", 99, {}, edit=lambda text, p, kept: (*(lambda r: (r[0], {}, r[1]))(D.unshield(text, kept)),)))

#: A demonstration pass, which is not registered.
UPPERCASE_HEADINGS = Pass("example_uppercase_headings", "Upper-case headings", 999, {"heading_levels": [1, 2]}, edit=_plain(_upper),
                          checks=(("heading_levels must be a list of 1 to 6", lambda p: bool(p["heading_levels"]) and all(x in range(1, 7) for x in p["heading_levels"])),))

_SAFE = ("equation_extraction", "ocr_cleanup", "header_footer_detection")
_BALANCED = (*_SAFE, "content_boilerplate", "reference_section_removal", "boilerplate_section_removal", "citation_removal")
MODES: dict[str, tuple[str, ...]] = {
    "safe": (*_SAFE, "equation_restoration"),
    "balanced": (*_BALANCED, "global_paragraph_deduplication", "equation_restoration"),
    "rag": (*_BALANCED, "global_paragraph_deduplication", "equation_restoration"),
    "aggressive": (*_BALANCED, "table_compression", "semantic_table_transform", "global_paragraph_deduplication", "abbreviation_mining", "semantic_deduplication", "importance_aware", "equation_restoration"),
}
V2_ORDER = (*_SAFE, "content_boilerplate", "boilerplate_section_removal", "reference_section_removal", "citation_removal", "table_compression", "semantic_table_transform",
            "global_paragraph_deduplication", "abbreviation_mining", "importance_aware", "equation_restoration")


@dataclass(frozen=True)
class Pipeline:
    """Passes in order, parameters and switches by pass. Only what is given overrides a default."""

    order: tuple[str, ...]
    params: dict[str, dict] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    fail_fast: bool = False

    @staticmethod
    def of(config: dict) -> Pipeline:
        """From a mapping as a settings file holds it: pass_order, pass_configs {name: {enabled, params}}, fail_fast."""
        if not isinstance(config.get("pass_order", []), list):
            raise PipelineConfigError("pass_order must be a list")
        own = config.get("pass_configs", {}) or {}
        return Pipeline(tuple(config.get("pass_order", [])), {k: v.get("params", {}) for k, v in own.items()}, frozenset(k for k, v in own.items() if v.get("enabled") is False), bool(config.get("fail_fast", False)))

    @staticmethod
    def mode(name: str) -> Pipeline:
        return Pipeline(MODES.get(name, MODES["balanced"]))

    def enabled(self) -> list[str]:
        return [n for n in self.order if n not in self.disabled]

    def resolved(self) -> list[tuple[Pass, dict]]:
        found = [get(n) for n in self.order]
        return [(p, p.settings(self.params.get(p.name))) for p in found if p.name not in self.disabled]


_STAT = "struct<pass_name:string,chars_before:bigint,chars_after:bigint,tokens_before:bigint,tokens_after:bigint,duration_s:double,error:string,metrics:map<string,bigint>,details:string>"


def run(docs: DataFrame, pipeline: Pipeline, content: str = "content") -> DataFrame:
    """docs with the content rewritten, and columns ``eq_map`` and ``history`` (one struct for each pass).

    A document whose pass fails keeps the text from before it; with fail_fast the job fails instead. Null content
    is empty. Column expressions are not timed: their duration is null.
    """
    df = docs.withColumn(content, F.coalesce(F.col(content), F.lit("")))
    df = df.withColumns({"eq_map": F.create_map().cast("map<string,string>"), "history": F.array().cast(f"array<{_STAT}>")})
    waiting: list[tuple[Pass, dict]] = []
    for item, p in [*pipeline.resolved(), (None, {})]:
        if item is not None and item.edit:
            waiting.append((item, p))
            continue
        if waiting:
            df = _by_document(df, waiting, content, pipeline.fail_fast)
            waiting = []
        if item is not None:
            df = _by_columns(df, item, p, content)
    return df


def _by_columns(df: DataFrame, item: Pass, p: dict, content: str) -> DataFrame:
    old = T.free_name(df, "before")
    df = df.withColumn(old, F.col(content))
    for step in item.steps(p):
        df = df.withColumn(content, step(F.col(content)))
    counts = item.counts(F.col(old), p)
    pairs = [x for k, v in counts.items() for x in (F.lit(k), v.cast("long"))]
    stat = F.struct(
        F.lit(item.name).alias("pass_name"), F.length(old).cast("long").alias("chars_before"), F.length(content).cast("long").alias("chars_after"),
        T.tokens(F.col(old)).alias("tokens_before"), T.tokens(F.col(content)).alias("tokens_after"), F.lit(None).cast("double").alias("duration_s"), F.lit(None).cast("string").alias("error"),
        F.create_map(*pairs).cast("map<string,bigint>").alias("metrics"), item.details(F.col(old), p).alias("details"),
    )
    return df.withColumn("history", F.concat("history", F.array(stat))).drop(old)


#: Documents that go to a Python worker at once, and their characters that are lists of Python strings there at once.
BATCH_ROWS, BATCH_CHARS = 256, 1 << 20


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows whose sizes add up to most or less; a larger row is a run of its own."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i - first
            first, total = i, 0
        total += n
    if sizes:
        yield first, len(sizes) - first


def _by_document(df: DataFrame, items: list[tuple[Pass, dict]], content: str, fail_fast: bool) -> DataFrame:
    # A run of passes has as many Python workers in each task as trips, and a batch is in Spark, on the way, and in the worker.
    small_batches(df.sparkSession, BATCH_ROWS)
    added = T.free_name(df, "added")
    df = df.withColumn(added, F.array().cast(df.schema["history"].dataType))
    schema = df.schema
    at = {n: schema.names.index(n) for n in (content, "eq_map", added)}

    def edit(text: str, kept: dict) -> tuple[str, dict, list]:
        history = []
        for item, p in items:
            began, error, metrics = time.perf_counter(), None, {}
            mode = {"mode": p["mode"]} if "mode" in p else {}
            new, new_kept = text, kept
            try:
                new, new_kept, metrics = item.edit(text, p, kept) if text else (text, kept, {})
            except Exception as e:
                if fail_fast:
                    raise PassExecutionError(f"{item.name}: {e}") from e
                error = str(e)
            details = mode | metrics.get("details", {})
            counters = [(k, int(v)) for k, v in metrics.items() if k != "details"]
            history.append((item.name, len(text), len(new), D.tokens(text), D.tokens(new), time.perf_counter() - began, error, counters, json.dumps(details, ensure_ascii=False) if details else None))
            text, kept = new, new_kept
        return text, kept, history

    names = [f.name for f in schema["history"].dataType.elementType.fields]

    stat = pa.struct([("pass_name", pa.string()), *((n, pa.int64()) for n in names[1:5]), ("duration_s", pa.float64()), ("error", pa.string()), ("metrics", pa.map_(pa.string(), pa.int64())), ("details", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column(at[content])).to_pylist()]
            for first, n in pieces(sizes, BATCH_CHARS):
                part = batch.slice(first, n)
                done = [edit(t or "", dict(k or [])) for t, k in zip(part.column(at[content]).to_pylist(), part.column(at["eq_map"]).to_pylist())]
                columns = list(part.columns)
                columns[at[content]] = pa.array([d[0] for d in done], pa.string())
                columns[at["eq_map"]] = pa.array([list(d[1].items()) for d in done], pa.map_(pa.string(), pa.string()))
                columns[at[added]] = pa.array([[dict(zip(names, h)) for h in d[2]] for d in done], pa.list_(stat))
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(work, schema).withColumn("history", F.concat("history", added)).drop(added)


def content_removed(history: Column) -> Column:
    """JSON: what five passes found or took out, by pass; those that did not run or failed are absent.

    A pass that ran more than once is told by its last run. Citations in protected zones are those skipped.
    """
    last = lambda name: F.try_element_at(F.filter(history, lambda h: (h["pass_name"] == name) & h["error"].isNull()), F.lit(-1))

    def part(name: str, fields: Callable[[Callable[[str], Column], Column], dict[str, Column]], mode: bool = True) -> Column:
        of = last(name)
        count = lambda key: F.coalesce(F.try_element_at(of["metrics"], F.lit(key)), F.lit(0).cast("long"))
        head = [F.get_json_object(of["details"], "$.mode").alias("mode")] if mode else []
        return F.when(of.isNotNull(), F.struct(*head, *[c.alias(k) for k, c in fields(count, of["metrics"]).items()]))

    groups = lambda m: F.transform_keys(F.map_filter(m, lambda k, v: F.startswith(k, F.lit("group_"))), lambda k, v: F.substr(k, F.lit(len("group_") + 1)))
    return F.to_json(F.struct(
        part("citation_removal", lambda n, m: {"total_removed": n("numeric") + n("author_year"), "numeric_bracket": n("numeric"), "author_year": n("author_year"), "protected_zones_skipped": n("protected")}).alias("citations"),
        part("reference_section_removal", lambda n, m: {"sections_found": n("sections_found"), "total_entries": n("entries"), "lines_affected": n("lines_affected")}).alias("reference_sections"),
        part("boilerplate_section_removal", lambda n, m: {"sections_found": n("sections_found"), "groups_found": groups(m), "lines_affected": n("lines_affected")}).alias("boilerplate_sections"),
        part("global_paragraph_deduplication", lambda n, m: {"paragraphs_scanned": n("checked"), "duplicates_removed": n("removed"), "duplicate_groups": n("groups")}).alias("duplicate_paragraphs"),
        part("header_footer_detection", lambda n, m: {"patterns_detected": n("header_patterns") + n("footer_patterns"), "lines_removed": n("lines_removed")}, mode=False).alias("headers_footers"),
    ))


def report(done: DataFrame, original: str = "original_content", content: str = "content") -> DataFrame:
    """One row per document: totals over its history, the passes as JSON, and the seconds they took together.

    Durations differ from run to run; they are in the last column alone.
    """
    before, after = T.tokens(F.coalesce(F.col(original), F.lit(""))), T.tokens(F.col(content))
    return done.select(
        "doc_id", F.size("history").cast("long").alias("passes"), before.alias("original_tokens"), after.alias("final_tokens"),
        F.greatest(before - after, F.lit(0)).alias("tokens_saved"),
        F.when(before > 0, F.round(F.greatest(before - after, F.lit(0)) * 100.0 / before, 2)).otherwise(0.0).alias("percent_saved"),
        F.size(F.filter("history", lambda h: h["error"].isNotNull())).cast("long").alias("errors"),
        F.to_json(F.transform("history", lambda h: h.dropFields("duration_s", "details"))).alias("pass_details"), content_removed(F.col("history")).alias("content_removed"),
        F.aggregate("history", F.lit(0.0), lambda s, h: s + F.coalesce(h["duration_s"], F.lit(0.0))).alias("duration_s"),
    )


def describe(pipeline: Pipeline) -> str:
    """The passes that would run with their parameters, as JSON."""
    return json.dumps([{"pass": i.name, "params": {k: v for k, v in p.items() if not callable(v)}} for i, p in pipeline.resolved()])
