"""Secret scans: candidate strings judged by a random forest, in SQL functions alone.

Candidates are (CANDIDATE) values of six characters or more that are set to a password-like name or follow "bearer"
or "basic", passwords in the user part of a url, private-key blocks, tokens of parts joined by dots that have a known
beginning, and runs of 16 or more letters, digits and ``+ / _ = -`` with a digit among them. A random forest on the
candidate's length, character transitions, dictionary coverage, path and neighbouring words removes false
findings. It is trained on labelled findings (before, candidate, after, label) whose features come from the same
SQL, and is compiled into one SQL expression. The dictionary is the most frequent words of a public vocabulary.
"""

from __future__ import annotations

import base64
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

THRESHOLD = 0.5
MASK = "[SECRET]"
TREES = 25
DEPTH = 7
#: Characters before and after a candidate that are its neighbourhood.
NEAR = 48
#: Rank file that the dictionary is taken from, and how many of its words.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = 4000

# Names that secrets are set to, words that tell harmless strings, beginnings of issued tokens.
NAMES = "secret|token|passwd|passw|pwd|passphrase|api.?key|credential|access.?key|private.?key|account.?key|auth"
HARMLESS = "example|dummy|sample|placeholder|changeme|checksum|sha-?1|sha-?256|md5|commit|uuid|guid|digest|hash|card|order|phone|isbn|version|build|invoice|revision"
ISSUED = "ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|rk_live_|sk-|AKIA|ASIA|AIza|npm_|pypi-|SG[.]|ya29[.]|eyJ|-----BEGIN"

_RUN = "A-Za-z0-9+/_=\\-"
_SET = f"(?i:{NAMES})[A-Za-z0-9_.\\-]*+[\"']?\\s*+(?:=>|:=|[:=])\\s*+[\"']?(?:(?i:bearer|basic)\\s++)?"
_BLOCK = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-----END [A-Z ]{0,60}-----)?"
_DOTTED = "(?<![A-Za-z0-9_.\\-])(?:eyJ[A-Za-z0-9_\\-]{8,}+|SG|ya29)(?:[.][A-Za-z0-9_\\-]{8,}+){1,4}"
#: Group 1 is what stands before the candidate; the empty groups in it tell which value may follow.
CANDIDATE = (
    f"({_SET}()|://[^\\s/:@]*+:()|(?i:bearer|basic)\\s++()|)"
    f"(?:{_BLOCK}|{_DOTTED}|\\2[^\\s\"'\\[\\],;<>(){{}}]{{6,}}+|\\3[^\\s/:@]++(?=@)|\\4[{_RUN}.~]{{12,}}+|(?<![{_RUN}])(?=[A-Za-z+/_=\\-]*[0-9])[{_RUN}]{{16,}}+)"
)
#: Texts without any of these hold no candidate.
GATE = f"[0-9]|(?i:{NAMES}|bearer|basic)|://[^\\s/]*@|-----BEGIN|eyJ"


def _trie(words: list[str]) -> str:
    """A pattern that matches the words, by their common beginnings."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [k + write(v) for k, v in sorted(node.items()) if k]
        return "" if not parts else f"(?:{'|'.join(parts)}){'?' if '' in node else ''}"

    return write(tree)


@lru_cache(maxsize=4)
def dictionary(vocabulary: str = VOCABULARY, words: int = WORDS) -> tuple[str, ...]:
    """The first so many words of four lower-case letters or more that begin a token of the vocabulary, by rank."""
    with open(vocabulary, "rb") as file:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
    found = [t[1:].decode() for _, t in ranked if len(t) > 4 and t[:1] == b" " and t[1:].isalpha() and t[1:].isascii() and t[1:].islower()]
    return tuple(found[:words])


def features(words: tuple[str, ...] | None = None) -> dict[str, str]:
    """SQL for each feature of Z: Z.b the text before the candidate, Z.c the candidate, Z.a the text after it."""
    known = _trie(list(dictionary() if words is None else words))
    return {
        "length": "cast(length(Z.c) as double)",
        "digits": "regexp_count(Z.c, '[0-9]') / length(Z.c)",
        "capitals": "regexp_count(Z.c, '[A-Z]') / length(Z.c)",
        "transitions": "regexp_count(Z.c, '[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])') / length(Z.c)",
        "clusters": "regexp_count(lower(Z.c), '[bcdfghjklmnpqrstvwxz](?=[bcdfghjklmnpqrstvwxz]{2})') / length(Z.c)",
        "distinct": "size(array_distinct(split(Z.c, ''))) / length(Z.c)",
        "marks": "regexp_count(Z.c, '[^A-Za-z0-9]') / length(Z.c)",
        "covered": f"1 - length(regexp_replace(lower(Z.c), '{known}', '')) / length(Z.c)",
        "letters": "if(Z.c rlike '^[a-z]+$|^[A-Z]?[a-z]+$', 1D, 0D)",
        "numeric": "if(Z.c rlike '^[0-9+_/=.,:-]+$', 1D, 0D)",
        "grouped": "if(Z.c rlike '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$', 1D, 0D)",
        "slashes": "cast(regexp_count(Z.c, '/') as double)",
        "in_path": "if(Z.b rlike '(://|/|\\\\\\\\|@|[.])[^\\\\s:]*$' or Z.a rlike '^([.@/\\\\\\\\])[A-Za-z0-9]', 1D, 0D)",
        "login": "if(Z.b rlike '://[^\\\\s/:@]*:$' and Z.a rlike '^@', 1D, 0D)",
        "issued": f"if(Z.c rlike '^({ISSUED})', 1D, 0D)",
        "keyword": f"if(Z.b rlike '(?i)({NAMES}|bearer|hooks)[^\\\\n]*$', 1D, 0D)",
        "named": f"if(Z.b rlike '(?i)({NAMES})[A-Za-z0-9_.-]*[\\\\x22\\\\x27]?\\\\s*(=>|:=|[:=])?\\\\s*[\\\\x22\\\\x27]?((bearer|basic)\\\\s+)?$|(?i)(bearer|basic)\\\\s+$', 1D, 0D)",
        "assigned": "if(Z.b rlike '[:=>]\\\\s*[\\\\x22\\\\x27]?$', 1D, 0D)",
        "quoted": "if(Z.b rlike '[\\\\x22\\\\x27]$' and Z.a rlike '^[\\\\x22\\\\x27]', 1D, 0D)",
        "harmless": f"if(Z.b rlike '(?i)({HARMLESS})[^\\\\n]*$', 1D, 0D)",
        "placeholder": f"if(lower(Z.c) rlike '{HARMLESS}|your|xxxx|[$*%]', 1D, 0D)",
    }


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    at: float
    low: Leaf | Split
    high: Leaf | Split


def _struct(b: str, c: str, a: str) -> str:
    """SQL struct of the features of text before, candidate and text after."""
    fields = ", ".join(f"cast({v} as double) as {k}" for k, v in features().items())
    return f"transform(array(struct({b} as b, {c} as c, {a} as a)), Z -> struct({fields}))[0]"


_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, label) made by rule: keys and passwords of common shapes in
    their usual settings, and strings that look alike: identifiers, hashes, numbers, paths, addresses, words."""
    r = random.Random(seed)
    syllables = [x + y for x in "b d f g k l m n p r s t v th st pr ch".split() for y in "a e i o u en or al is".split()]
    made = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    known = dictionary()
    word = lambda: r.choice(known) if r.random() < 0.5 else made()
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 8)))
    name = lambda: r.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "private_key", "client_secret", "TOKEN", "DB_PASSWORD", "passwd", "pwd", "aws_secret_access_key", "credentials", "x-api-key"])
    form = lambda: r.choice([' = "', '="', ": ", "=", "='", ' : "', '": "', " => '", ":"])
    quote = lambda f: '"' if f.endswith('"') else "'" if f.endswith("'") else ""
    rows = []
    for _ in range(n):
        before, after = prose() + " ", r.choice(["", ".", ",", "\n", " "]) + " " + prose()
        if r.random() < 0.5:
            shape = r.choice((0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 6, 7, 8))
            if shape <= 2:
                value = r.choice([some(_HEX, r.choice([32, 40, 64])), some(_HEX.upper(), r.choice([32, 40])), some(_ALNUM, r.randint(16, 48)), some(_ALNUM + "+/", 40), some(_ALNUM, 8) + "-" + some(_ALNUM, 12) + "_" + some(_ALNUM, 10), some(_ALNUM + "!#%^*", r.randint(8, 20))])
                f = form()
                before, after = before + name() + f, quote(f) + after
            elif shape == 3:
                value = r.choice([some(_ALNUM[26:52], r.randint(12, 32)), some(_ALNUM[:52], r.randint(12, 32))])
                f = form()
                before, after = before + name() + f, quote(f) + after
            elif shape == 4:
                value = r.choice([word() + str(r.randint(1, 9999)) + r.choice(["", "!", "x", "#"]), word().capitalize() + some("0123456789!@", r.randint(1, 4)) + made(), some(_ALNUM[26:], r.randint(7, 14)) + r.choice(_ALNUM[52:])])
                value = value if len(value) >= 6 else value + "77x"
                f = form()
                before, after = before + r.choice(["password", "passwd", "pwd", "token", "secret", "DB_PASSWORD"]) + f, quote(f) + after
            elif shape == 5:
                value = r.choice([some(_ALNUM, r.randint(6, 20)), word() + some(_ALNUM, 3), some(_ALNUM + "!$%", 12)])
                before += r.choice(["postgres", "mysql", "redis", "https", "amqp", "mongodb"]) + "://" + r.choice([word(), "", "admin"]) + ":"
                after = "@" + r.choice(["db.", "10.0.0.", ""]) + word() + after
            elif shape == 6:
                value = r.choice(
                    ["ghp_" + some(_ALNUM, 36), "gho_" + some(_ALNUM, 36), "glpat-" + some(_ALNUM, 20), "xoxb-" + some("0123456789", 11) + "-" + some("0123456789", 12) + "-" + some(_ALNUM, 24), "sk_live_" + some(_ALNUM, 24), "AKIA" + some(_ALNUM[:26] + "234567", 16), "AIza" + some(_ALNUM + "_-", 35), "sk-" + some(_ALNUM, 48), "npm_" + some(_ALNUM, 36)]
                )
                before += r.choice(["", name() + " ", name() + "=", name().upper() + "_ID=", "key ", "use "])
            elif shape == 7:
                part = lambda k: some(_ALNUM + "_-", k)
                value = r.choice(["eyJ" + part(r.randint(17, 40)) + ".eyJ" + part(r.randint(20, 90)) + "." + part(43), "SG." + part(22) + "." + part(43), "ya29." + part(60)])
                before += r.choice(["", "Authorization: Bearer ", name() + "=", "cookie ", "jwt "])
            else:
                if r.random() < 0.5:
                    kind = r.choice(["RSA ", "EC ", "OPENSSH ", ""])
                    value = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(some(_ALNUM + "+/", 64) for _ in range(r.randint(1, 12))) + f"\n-----END {kind}PRIVATE KEY-----"
                else:
                    value = some(_ALNUM + "-_", r.randint(16, 40))
                    before += r.choice(["Bearer ", "Authorization: Bearer ", "Authorization: Basic "])
            rows.append((before[-NEAR:], value, after[:NEAR], 1))
            continue
        kind = r.randint(0, 13)
        if kind == 0:
            value = some("0123456789", r.randint(16, 20))
            before += r.choice(["", "card ", "order ", "no. ", "id="])
        elif kind == 1:
            value = "-".join(some(_HEX, k) for k in (8, 4, 4, 4, 12))
            before += r.choice(["uuid ", "id ", "guid=", ""])
        elif kind == 2:
            value = some(_HEX, r.choice([32, 40, 64]))
            before += r.choice(["commit ", "sha256: ", "md5 ", "checksum = ", "digest ", "sha1=", "revision ", "", "see "])
        elif kind == 3:
            value = "/".join(word() for _ in range(4)) + "/" + some("0123456789", 4)
            before += r.choice(["https://www.example.com/", "/", "see /", "http://" + made() + ".org/"])
            after = r.choice([".html", ".png", "/ ", ""]) + after
        elif kind == 4:
            value = word() + "-" + word() + "-" + word() + "-" + word() + str(r.randint(1, 2024))
        elif kind == 5:
            hump = lambda k: "".join(word().capitalize() for _ in range(k))
            value = r.choice([word() + hump(2) + str(r.randint(1, 99)), r.choice(["get", "set", "is", "to"]) + hump(r.randint(2, 3)) + str(r.randint(1, 9)) + hump(1), hump(2) + "2" + hump(1), word() + "_" + word() + "_" + word() + "_" + str(r.randint(1, 99))])
            value += "_" + word() if len(value) < 16 else ""
            before += r.choice(["", "class ", "def ", "#"])
        elif kind == 6:
            value = r.choice(["example", "dummy", "sample", "placeholder", "your_key_", "xxxxxxxx"]) + r.choice([some(_ALNUM, 4) + "0123456789", "_token", "", "-password-here"])
            before += name() + form()
        elif kind == 7:
            value = word() + word() + word() + str(r.randint(10, 99))
            after = "@mail.example.com" + after
        elif kind == 8:
            value = some("0123456789", 8) + "-" + some("0123456789", 8)
            before += r.choice(["phone ", "+1 ", "isbn ", "range "])
        elif kind in (9, 10):
            value = r.choice([word(), word().capitalize(), word() + "-" + word(), word() + r.choice([".", "!", "?"]), "required", "optional", "string", "expired", "invalid", "required.", "null", "undefined", "process.env." + word().upper(), "config." + word(), "str(" + word()])
            value = value if len(value) >= 6 else value + "ations"
            before += r.choice(["the password: ", "token: ", "secret: ", "authors: ", "Author: ", "a token = ", "passwords: ", "authentication: ", "credentials: ", "authority: ", "secretary: "])
        elif kind == 11:
            value = r.choice([some("0123456789", r.randint(6, 10)), "20" + some("0123456789", 2) + "-" + some("01", 2) + "-" + some("012", 2)])
            before += r.choice(["tokens: ", "n_tokens=", "max_tokens: ", "token_count = ", "author_id: ", "authored: "])
        elif kind == 12:
            value = r.choice([some("ACGT", 30) + "1", "=" * 20 + "1", "-" * 18 + "2", "0x" + "0" * 16, "1" * 24, some("01", 24)])
        else:
            value = some("0123456789", 2) + word() + r.choice(["-", "_", "/"]) + word() + r.choice(["-", "_", "/"]) + word() + word()
            value += word() if len(value) < 16 else ""
        rows.append((before[-NEAR:], value, after[:NEAR], 0))
    return rows


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], r: random.Random, depth: int) -> Leaf | Split:
    """A tree of the given depth on some of the features at each split, by Gini impurity."""
    ones = int(y.sum())
    leaf = Leaf((ones + 0.5) / (len(y) + 1))
    if depth == 0 or ones in (0, len(y)) or len(y) < 8:
        return leaf
    best = None
    for f in sorted(r.sample(range(len(names)), max(2, len(names) // 3))):
        values = np.unique(x[:, f])
        cuts = min(len(values), 25)
        for k in range(1, cuts):
            i = k * len(values) // cuts
            at = float((values[i - 1] + values[i]) / 2)
            low = x[:, f] <= at
            n, a = int(low.sum()), int(y[low].sum())
            m, b = len(y) - n, ones - a
            if n and m:
                impurity = a * (n - a) / n + b * (m - b) / m
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, at
    if best is None:
        return leaf
    _, f, at = best
    low = x[:, f] <= at
    return Split(names[f], at, _grow(x[low], y[low], names, r, depth - 1), _grow(x[~low], y[~low], names, r, depth - 1))


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Leaf | Split]:
    """A forest from labelled findings, the same at every run. The features are computed by Spark SQL."""
    rows = findings if findings is not None else labelled_findings()
    df = spark.createDataFrame(rows, "b string, c string, a string, y int")
    found = sorted((*x.f, x.y) for x in df.select(F.expr(_struct("b", "c", "a")).alias("f"), "y").collect())
    table = np.array(found, np.float64).reshape(len(found), len(features()) + 1)
    r, names = random.Random(seed), list(features())
    picks = [np.array([r.randrange(len(found)) for _ in found], int) for _ in range(trees)]
    return [_grow(table[p, :-1], table[p, -1], names, r, depth) for p in picks]


def forest_sql(forest: list[Leaf | Split], of: str) -> str:
    """The mean vote as SQL over the struct named ``of``."""

    def sql(node: Leaf | Split) -> str:
        if isinstance(node, Leaf):
            return f"{node.value!r}D"
        return f"if({of}.{node.feature} <= {node.at!r}D, {sql(node.low)}, {sql(node.high)})"

    return f"({' + '.join(sql(t) for t in forest)}) / {len(forest)}"


def scan(docs: DataFrame, text_col: str = "text", forest: list[Leaf | Split] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with scratch columns, and their names: ``findings`` (array of start, length, score, is_secret) and
    ``redacted`` (the text with secrets masked; null for a null text). Start counts code points from 0."""
    forest = train(docs.sparkSession) if forest is None else forest
    names = {k: free_name(docs, k) for k in ("text", "whole", "found", "between", "marked", "findings", "redacted")}
    t, whole, found, between, marked = names["text"], names["whole"], names["found"], names["between"], names["marked"]
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    may = f"{t} rlike {quote(GATE)}"
    pick = _struct(f"right({between}[i], {NEAR})", f"{found}[i]", f"left({between}[i + 1], {NEAR})")
    score = f"transform(array({pick}), f -> {forest_sql(forest, 'f')})[0]"
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    both = f"arrays_zip(regexp_extract_all({t}, {quote(CANDIDATE)}, 0), regexp_extract_all({t}, {quote(CANDIDATE)}, 1))"
    df = df.withColumn(whole, F.expr(f"if({may}, {both}, array())"))
    df = df.withColumn(found, F.expr(f"transform({whole}, x -> substring(x['0'], length(x['1']) + 1))"))
    parts = f"transform(split({t}, {quote(CANDIDATE)}, -1), (x, i) -> if(i < size({whole}), concat(x, {whole}[least(i, size({whole}) - 1)]['1']), x))"
    df = df.withColumn(between, F.expr(f"if(size({whole}) > 0, {parts}, array())"))
    df = df.withColumn(marked, F.expr(f"if(size({found}) > 0, transform(sequence(0, size({found}) - 1), i -> {score}), array())"))
    df = df.withColumns(
        {
            names["findings"]: F.expr(
                f"""transform({found}, (c, i) -> struct(
                cast(aggregate(slice({between}, 1, i + 1), 0, (n, x) -> n + length(x)) + aggregate(slice({found}, 1, i), 0, (n, x) -> n + length(x)) as long) as start,
                cast(length(c) as long) as length, {marked}[i] as score, {marked}[i] >= {THRESHOLD}D as is_secret))"""
            ),
            names["redacted"]: F.expr(
                f"""case when `{text_col}` is null then null when not exists({marked}, s -> s >= {THRESHOLD}D) then {t} else
                array_join(transform({between}, (x, i) -> concat(x, if(i < size({found}), if({marked}[least(i, size({found}) - 1)] >= {THRESHOLD}D, '{MASK}', {found}[least(i, size({found}) - 1)]), ''))), '') end"""
            ),
        }
    )
    return df, names


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: list[Leaf | Split] | None = None) -> DataFrame:
    """docs -> doc_id, n_candidates, n_secrets, findings, redacted_sha256: one row per row.

    Null and empty texts have no findings; very long texts are searched whole; rows that repeat or have no id get
    equal results; no rows give no rows; other columns are not looked at.
    """
    df, names = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), forest=forest)
    f = names["findings"]
    return df.select(
        "doc_id", F.size(f).cast("long").alias("n_candidates"), F.expr(f"cast(size(filter({f}, x -> x.is_secret)) as long)").alias("n_secrets"),
        F.col(f).alias("findings"), F.sha2(F.coalesce(names["redacted"], F.lit("")), 256).alias("redacted_sha256"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", forest: list[Leaf | Split] | None = None) -> DataFrame:
    """docs with secrets masked in the text, its length brought up to date where it has changed; same columns.

    A null text stays null. Rows are kept, however often they are there; scratch columns avoid the names of docs.
    """
    df, names = scan(docs, text_col, forest)
    new = names["redacted"]
    changed = ~F.col(new).eqNullSafe(F.col(text_col))
    out = {text_col: F.col(new)}
    if length_col in docs.columns:
        out[length_col] = F.when(changed, F.length(new)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
