"""Passes and phrases on texts of many scripts and sizes."""

import random

import duckdb
from pyspark.sql import functions as F

from loomtext import catalog
from loomtext.functions import text as T
from loomtext.operators import documents as D, relations


def test_phrases_end_where_the_sql_ends_them(spark):
    """A letter that is not ASCII ends a phrase, as it does in DuckDB."""
    texts = ["Erathe Cióní. " * 3, "Über Quantum Key. éQuantum Key, Quantum Key", "Alpha Beta\x0bGamma " * 3, "Alpha Beta. " * 3 + "éAB", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    got = relations.phrases(docs).select("doc_id", "phrase", "frequency", "acronym").collect()
    con = duckdb.connect()
    con.execute("create table md (doc_id bigint, content varchar)")
    con.executemany("insert into md values (?, ?)", list(enumerate(texts)))
    want = con.sql("WITH " + catalog._PHRASES.removeprefix(", ") + "SELECT doc_id, phrase, frequency, acronym FROM h WHERE rank = 1").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert (0, "Erathe Ci", 3, "EC") in want


def test_white_space_at_the_ends(spark):
    """strip takes all that Unicode calls white space, and nothing else."""
    texts = [c + "a" + c + "b" + c for c in map(chr, [*range(1, 0x300), *range(0x1600, 0x1700), *range(0x2000, 0x2070), 0x3000, 0xFEFF])] + ["", " \n\u2003", "x\u0085\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_groups_of_lines_as_by_the_matcher_alone():
    """The bounds that spare the sequence matcher change no group, and spare it lines of other letter pairs."""
    rnd = random.Random(3)

    def plain(keys, threshold):
        groups = []
        for k in keys:
            home = next((g for g in groups if any(D.SequenceMatcher(None, k, x).ratio() >= threshold for x in g)), None)
            groups.append([k]) if home is None else home.append(k)
        return groups

    for _ in range(150):
        letters = "ab cdeé€"[: rnd.choice([2, 4, 8])]
        base = ["".join(rnd.choices(letters, k=rnd.randint(1, 30))) for _ in range(4)]
        keys = set()
        for _ in range(15):
            s = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                s.insert(rnd.randrange(len(s) + 1), rnd.choice(letters))
            keys.add("".join(s))
        keys, threshold = sorted(keys, key=lambda k: (-len(k), k)), rnd.choice([0.5, 0.7, 0.85, 1.0])
        assert D.grouped(keys, threshold) == plain(keys, threshold)


def test_line_groups_do_not_try_lines_of_other_letter_pairs(monkeypatch):
    """Lines of the same letters in another order share few pairs: their common subsequence is not looked for."""
    tried = []
    monkeypatch.setattr(D, "common", lambda *a, real=D.common: tried.append(a) or real(*a))
    keys = ["abcdefghijklmnopqrst" * 3, "tsrqponmlkjihgfedcba" * 3]
    assert D.grouped(keys, 0.85) == [[k] for k in keys] and not tried
