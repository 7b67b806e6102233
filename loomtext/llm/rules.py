"""Quality rules: a table of thresholds compiled into one projection of SQL functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name

#: Frequent words of the corpus languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were what which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "auf das dem den der die ein eine er für ich im ist mit nicht sich sie und von zu "
    "al como con del el es las lo los más no para por su una y"
).split()

#: Least words and the greatest share of words in repeated windows of a document that is looked at further.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A document goes if numerator / denominator is below low or above high; a denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("words", "n_words", "1", low=50, high=10_000_000),
    Rule("word_length", "word_chars", "n_words", low=2, high=20),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("exclamations", "n_exclamations", "n_words", high=0.75),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)


def verdict(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as one SQL condition that holds for documents to keep."""
    parts = []
    for r in rules:
        ratio = f"try_divide(cast({r.numerator} as double), {r.denominator})"
        tests = [f"{ratio} >= {r.low}D"] * (r.low is not None) + [f"{ratio} <= {r.high}D"] * (r.high is not None)
        parts.append(f"({r.denominator} = 0 or ({' and '.join(tests)}))")
    return " and ".join(parts)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_stop_words")


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """docs with scratch columns for the measures, base_failed and kept, and their names.

    Null text counts as empty; very long texts are measured whole; rows that repeat are measured each; no rows give no
    rows. Three-word windows are sorted by the 64-bit hash of their words, and by these inside equal hashes, so that
    like ones meet; the words in a window found twice or more are counted once each, the first find included. Each step is a column that
    later steps name more than once, so that the optimiser computes it once and doesn't inline it.
    """
    t, w, l, h, again, s, r = (free_name(docs, x) for x in ("t", "w", "l", "h", "again", "s", "r"))
    name = {m: free_name(docs, m) for m in (*MEASURES, "base_failed", "kept")}
    space = SPACE.replace("\\", "\\\\")
    spaces = "' \\u0009\\u000A\\u000B\\u000C\\u000D'"
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    same = lambda k: " and ".join(f"{s}[{k}].{x} = e.{x}" for x in "vabc")
    steps = [
        {t: f"coalesce(cast(`{text_col}` as string), '')"},
        {
            w: f"filter(split({t}, '{space}', -1), x -> x <> '')",
            l: f"filter(split({t}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')",
        },
        {h: f"if(size({w}) < 3, array(), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))"},
        {again: f"size({h}) > size(array_distinct({h}))"},
        {s: f"if({again}, sort_array(transform({h}, (v, i) -> struct(v as v, {w}[i] as a, {w}[i + 1] as b, {w}[i + 2] as c, i as i))), array())"},
        {
            r: f"""sort_array(transform(filter(transform({s}, (e, k) -> struct(e.i as i,
                (k > 0 and {same("greatest(k - 1, 0)")}) or (k + 1 < size({s}) and {same(f"least(k + 1, size({s}) - 1)")}) as hit)),
                e -> e.hit), e -> e.i))"""
        },
        {
            name["n_words"]: f"cast(size({w}) as long)",
            name["word_chars"]: f"cast(length(translate({t}, {spaces}, '')) as long)",
            name["n_symbols"]: f"cast(length({t}) - length(translate({t}, '#*$%&|<>', '')) as long)",
            name["n_dup_lines"]: f"cast(size({l}) - size(array_distinct({l})) as long)",
            name["n_repeat_words"]: f"cast(aggregate(transform({r}, (v, k) -> if(k = 0, 3, least(3, v - {r}[greatest(k - 1, 0)]))), 0, (a, v) -> a + v) as long)",
            name["n_lines"]: f"cast(size({l}) as long)",
            name["n_exclamations"]: f"cast(length({t}) - length(translate({t}, '!', '')) as long)",
            name["n_stop_words"]: f"cast(size(filter({w}, x -> lower(x) in ({stop}))) as long)",
        },
        {name["base_failed"]: f"{name['n_words']} < {MIN_WORDS} or 100 * {name['n_repeat_words']} > {MAX_REPEATED_PERCENT} * {name['n_words']}"},
    ]
    named = tuple(Rule(x.name, name.get(x.numerator, x.numerator), name.get(x.denominator, x.denominator), x.low, x.high) for x in rules)
    steps.append({name["kept"]: f"not {name['base_failed']} and {verdict(named)}"})
    df = docs
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df, name


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, the measures, base_failed and kept, one row per row.

    Ids may be null or repeat; null and empty texts have no words and fail; no rows give no rows; other columns, whatever
    their names, are not looked at.
    """
    df, name = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return df.select("doc_id", *[F.col(v).alias(k) for k, v in name.items()])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject; the columns are those of docs.

    The verdict goes through a generator instead of a filter: a filter would be pushed below the steps of
    ``measure`` and written out with all of them nested.
    """
    df, name = measure(docs, text_col)
    flag = free_name(docs, "flag")
    kept = df.select(*docs.columns, F.explode(F.expr(f"if({name['kept']}, array(true), array())")).alias(flag))
    return kept.select(*docs.columns)
