"""Document edits made of column expressions alone: base cleaner, character repair, boilerplate, citations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def heading_dedup(text: Column) -> Column:
    """Without heading lines that repeat one since the last first-level heading."""
    parts = F.split(text, r"(?dm)(?=^[ \t]*#\s)", -1)
    heads = lambda rows: F.transform(rows, lambda x: F.when(x.rlike(r"^\s*#{1,6}\s+\S"), T.strip(x)))

    def clean(part: Column) -> Column:
        rows = T.lines(part)
        placed = F.zip_with(heads(rows), rows, lambda h, x: F.struct(F.coalesce(h, F.lit("")).alias("h"), x.alias("x")))
        placed = F.sort_array(F.transform(placed, lambda r, i: F.struct(r["h"].alias("h"), i.alias("i"), r["x"].alias("x"))))
        new = lambda s: F.filter(s, lambda e, k: (e["h"] == "") | (k == 0) | (F.get(s, k - 1)["h"] != e["h"]))
        back = lambda kept: F.sort_array(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
        return F.array_join(F.transform(back(T.let(placed, new)), lambda e: e["x"]), "\n")

    return F.when(text.rlike(r"(?dm)^\s*#{1,6}\s"), F.array_join(F.transform(parts, clean), "")).otherwise(text)


def paragraph_dedup(text: Column) -> Column:
    """Without paragraphs equal to the one before."""
    parts = T.paragraphs(text, many=True)
    new = lambda bare: lambda x, i: (i == 0) | (F.get(bare, i) == "") | (F.get(bare, i) != F.get(bare, i - 1))
    return T.let(F.transform(parts, T.strip), lambda bare: F.array_join(F.filter(parts, new(bare)), "\n\n"))


def base_clean(text: Column) -> list[Callable[[Column], Column]]:
    """The steps of the base cleaner in order; each takes the text that the step before made."""
    return [
        lambda t: F.translate(F.regexp_replace(T.nfkc(t), " ", " "), T.INVISIBLE, ""),
        lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\f", ""), r"(?dm)[^\S\r\n]+$", ""), P.CONTROL, ""),
        lambda t: F.regexp_replace(t, f"(?dmi)^{P.PAGE_NUMBER}$", ""),
        T.collapse_blank,
        lambda t: F.regexp_replace(t, r"(?:\n[-*_]{3,}\n){2,}", "\n---\n"),
        heading_dedup,
        paragraph_dedup,
        lambda t: T.strip(F.regexp_replace(t, r"(?dm)[ \t]+$", "")),
    ]


def ocr_cleanup(p: dict) -> list[Callable[[Column], Column]]:
    """Character repair; zones are found anew at each step."""
    edit = lambda f: lambda t: T.outside(t, T.ZONES, f)
    steps: list[Callable[[Column], Column]] = []
    if p["remove_cid"]:
        steps.append(edit(lambda x: F.regexp_replace(x, P.CID, "")))
    if p["normalize_unicode"]:

        def ligatures(x: Column) -> Column:
            for a, b in P.LIGATURES.items():
                x = F.replace(x, F.lit(a), F.lit(b))
            return x

        steps.append(lambda t: F.when(t.rlike(f"[{''.join(P.LIGATURES)}]"), T.outside(t, T.ZONES, ligatures)).otherwise(t))
        steps.append(lambda t: F.translate(F.regexp_replace(T.nfkc(t), " ", " "), "​‌‍⁠﻿­͏  �", ""))
    if p["remove_control_chars"]:
        steps.append(edit(lambda x: F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")))
    if p["normalize_quotes"]:

        def quotes(x: Column) -> Column:
            for a, b in P.QUOTES.items():
                x = F.replace(x, F.lit(a), F.lit(b))
            return x

        steps.append(edit(quotes))
    if p["fix_whitespace"]:
        steps.append(edit(lambda x: F.regexp_replace(F.regexp_replace(x, P.CAMEL, "$1 $2"), "(?i)(?=[oiatbfwh])" + P.MERGED, "$1 $2")))
    if p["unwrap_lines"]:
        steps.append(edit(lambda x: F.regexp_replace(x, P.WRAPPED, "$1 $2")))
    if p["fix_punctuation"]:
        steps.append(edit(lambda x: F.regexp_replace(F.regexp_replace(x, r"(?<!\.)\.\.(?!\.)", "."), r"\s+([.,;:!?])", "$1")))
    steps.append(lambda t: F.regexp_replace(t, r"[ \t]{2,}", " "))
    return steps


def ocr_counts(t: Column) -> dict[str, Column]:
    return {
        "cid": F.regexp_count(t, F.lit(P.CID)), "control": F.regexp_count(t, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")),
        "camel": F.regexp_count(t, F.lit(P.CAMEL)), "wrapped": F.regexp_count(t, F.lit(P.WRAPPED)),
        "spaced_punctuation": F.regexp_count(t, F.lit(r"\s+[.,;:!?]")), "double_period": F.regexp_count(t, F.lit(r"(?<!\.)\.\.(?!\.)")),
    }


def content_boilerplate(p: dict) -> list[Callable[[Column], Column]]:
    """Table of contents, certificates, evaluation sheets, page numbers, repeated short lines; code is left alone."""
    fence = r"```[\s\S]*?```"
    listed = lambda x: F.lit(False) if not p["whitelist"] else F.array_contains(F.transform(F.array(*[F.lit(w.lower()) for w in p["whitelist"]]), lambda w: F.contains(F.lower(x), w)), True)
    steps: list[Callable[[Column], Column]] = []
    if p["remove_toc"]:
        toc = f"(?dmi)(?:{P.TOC_HEADING})(?:\\n(?:[ \\t]*|{P.TOC_ENTRY.replace('^', '').replace('$', '')})(?=\\n|\\z))*"

        def drop_toc(t: Column) -> Column:
            found = F.regexp_extract(t, toc, 0)
            in_code = ~T.outside(t, fence, lambda x: F.lit("")).contains(found)
            at = F.position(found, t)
            cut = F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + F.length(found)))
            return F.when((found != "") & in_code & ~listed(found), cut).otherwise(t)

        steps.append(lambda t: F.when(t.rlike(f"(?dmi){P.TOC_HEADING}"), drop_toc(t)).otherwise(t))
    def without(pattern: str) -> Callable[[Column], Column]:
        return lambda t: F.array_join(F.filter(T.paragraphs(t), lambda x: ~x.rlike(pattern) | x.rlike("```") | listed(x)), "\n\n")

    if p["remove_certificates"]:
        steps.append(without(f"(?i){P.CERTIFICATE}"))
    if p["remove_eval_sheets"]:
        steps.append(without(f"(?dmi){P.EVALUATION}"))
    if p["remove_page_numbers"]:
        steps.append(lambda t: T.outside(t, fence, lambda x: F.array_join(F.filter(T.lines(x), lambda r: ~r.rlike(f"(?i){P.PAGE_LINE}") | listed(r)), "\n")))
    if p["remove_repeated_lines"]:

        def repeated(t: Column) -> Column:
            """Sorted by text, like lines stand together: one goes if it has a like one before it and its run is long enough."""
            most, least = p["max_repeat_line_length"], p["min_repeat_count"]
            placed = F.sort_array(F.transform(T.lines(t), lambda x, i: F.struct(T.strip(x).alias("b"), i.alias("i"), x.alias("x"))))
            able = lambda b: (b != "") & (F.length(b) <= most) & ~b.rlike(r"^#{1,6}\s+") & ~listed(b)

            def keep(s: Column) -> Column:
                like = lambda e, k: F.coalesce(F.get(s, k)["b"] == e["b"], F.lit(False))
                long_run = lambda e, k: reduce(lambda a, b: a | b, [like(e, k - d) & like(e, k - d + least - 1) for d in range(1, least)])
                return F.filter(s, lambda e, k: ~(like(e, k - 1) & long_run(e, k) & able(e["b"])))

            kept = F.transform(T.let(placed, keep), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))
            return F.array_join(F.transform(F.sort_array(kept), lambda e: e["x"]), "\n")

        again = lambda bare: F.size(bare) - F.size(F.array_distinct(bare)) >= p["min_repeat_count"] - 1
        steps.append(lambda t: F.when(T.let(F.transform(T.lines(t), T.strip), again), repeated(t)).otherwise(t))
    steps.append(lambda t: T.strip(T.collapse_blank(t)))
    return steps


def _citation_patterns(p: dict) -> tuple[list[str], str]:
    """The patterns of citations looked for, and that of the zones in which none counts."""
    wanted = [x for on, x in (("detect_numeric", P.NUMERIC_CITATION), ("detect_author_year", P.AUTHOR_CITATION)) if p[on]]
    zones = [z for on, z in (("protect_code_blocks", r"```[\s\S]*?```|`[^`\n]+`"), ("protect_equations", r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$|\\\[[\s\S]*?\\\]|\\\([^\n]*?\\\)"), ("protect_markdown_links", r"!?\[[^\]]*\]\([^)]*\)|\[[^\]]*[a-zA-Z][^\]]*\]\[[^\]]*\]"), ("protect_footnotes", r"\[\^[^\]]+\]")) if p[on]]
    return wanted, "|".join(zones) or "(?!)"


#: The characters that the zones of citations begin with.
_ZONE_FIRST = r"`$\\!\["


def citation_counts(t: Column, p: dict) -> dict[str, Column]:
    """Citations outside of protected zones by kind, and those inside."""
    _, zones = _citation_patterns(p)
    # No citation holds the character that stands for a zone, so those of all parts are counted at once.
    free = F.regexp_replace(t, T.led(zones, _ZONE_FIRST), "\x00")
    count = lambda on, pattern, x: F.regexp_count(x, F.lit(pattern)) if p[on] else F.lit(0)
    kinds = {"numeric": ("detect_numeric", P.NUMERIC_CITATION), "author_year": ("detect_author_year", P.AUTHOR_CITATION)}
    found = {name: count(*kind, free) for name, kind in kinds.items()}
    return found | {"protected": F.greatest(sum(count(*kind, t) for kind in kinds.values()) - sum(found.values()), F.lit(0))}


def citation_details(t: Column, p: dict, most: int = 20) -> Column:
    """JSON: the mode, and the first citations outside of protected zones with their kinds."""
    wanted, zones = _citation_patterns(p)
    texts = F.regexp_extract_all(F.regexp_replace(t, T.led(zones, _ZONE_FIRST), "\x00"), F.lit("|".join(wanted) or "(?!)"), F.lit(0))
    examples = F.transform(F.slice(texts, 1, most), lambda x: F.struct(x.alias("text"), F.when(F.startswith(x, F.lit("[")), "numeric").otherwise("author_year").alias("type")))
    return F.to_json(F.struct(F.lit(p["mode"]).alias("mode"), examples.alias("examples")))


def citations(p: dict) -> list[Callable[[Column], Column]]:
    """Remove inline citations or put a placeholder, outside code, mathematics, links and footnotes."""
    if p["mode"] == "keep":
        return []
    wanted, zones = _citation_patterns(p)
    if not wanted:
        return []
    new = "" if p["mode"] == "remove" else p["placeholder"].replace("\\", "\\\\").replace("$", "\\$")
    steps = [lambda t: T.outside(t, zones, lambda x: F.regexp_replace(x, "|".join(wanted), new), _ZONE_FIRST)]
    if new and p["merge_adjacent_placeholders"]:
        import re

        mark = re.escape(p["placeholder"])
        steps.append(lambda t: F.regexp_replace(t, f"(?:{mark}\\s*)+{mark}", new))
    steps.append(lambda t: F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\s+([.,;:!?])", "$1"))
    return steps
