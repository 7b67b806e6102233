"""Each training-data operator against a plain version of itself, and on odd tables."""

import hashlib
import itertools
import re
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import bpe, digest, mixing, quality, queries, rules, secrets, simhash, tokens, toxicity, urls
from loomtext.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of the long text {i}" for i in range(20000))
ODD = [
    (1, None, "en", None, None), (2, "", None, "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "One two three four", "en", "b", 18), (4, "One two three four", "en", "b", 18),
    (5, "ONE two  three\nfour", "en", "b", 19), (None, "no id here", "en", "c", 10), (None, None, None, None, None), (7, LONG, "en", "c", len(LONG)), (8, "x" * 200_000, "en", "c", 200_000),
    (9, "é ﬁ Straße 🙂 \u2003 end", "de", "a", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {"h": F.lit(1), "l": F.lit("x"), "fp": F.lit(2.0), "slice": F.lit(0), "__text": F.lit("t"), "kept": F.lit(True), "size": F.lit(5), "findings": F.lit("f"), "copies": F.lit(9), "component_id": F.lit(0), "y": F.lit(3)}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def canon(t):
    n = unicodedata.normalize
    return re.sub(r"\s+", " ", n("NFKC", n("NFKC", t).casefold())).strip()


def test_fingerprints(spark, docs):
    got = rows(spark, "op1_document_fingerprints").set_index("doc_id")
    down = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    seen = {}
    for i, d in down.iterrows():
        t, after = d.text, down.text[(i + 1) % len(down)]
        k = len(t) // 2
        edit = t[: len(t) - k] + after[:k]
        r = got.loc[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(t) == canon(edit)), float(canon(t) == canon(after)))
        seen.setdefault(canon(t), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in seen.values()) and len({y for x in seen.values() for y in x}) == len(seen)


def test_fingerprints_of_odd_rows(odd, none):
    got = digest.edited(odd).toPandas()
    assert len(got) == len(ODD)
    f = digest.fingerprints(odd).select("text", "fingerprint", "h").toPandas()
    by = {t: x for t, x in zip(f.text, f.fingerprint)}
    assert by["One two three four"] == by["ONE two  three\nfour"] and by[""] == by["   \n\t "] == f[f.text.isna()].fingerprint.iloc[0]
    assert digest.edited(none).count() == 0 and digest.fingerprints(none).count() == 0


def test_one_document_is_its_own_next(spark):
    got = digest.edited(spark.createDataFrame([(3, "abcdef", "", "", 6)], SCHEMA)).first()
    assert got.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and got.near_next == 1.0


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digest, "keys", lambda df, canon, high, low: df.withColumns({high: F.lit(7).cast("long"), low: F.lit(8).cast("long")}))
    df = spark.createDataFrame([(1, "a", "", "", 1), (2, "b", "", "", 1), (3, "A ", "", "", 2)], SCHEMA)
    got = {r.doc_id: r.fingerprint for r in digest.fingerprints(df).collect()}
    assert got[1] == got[3] != got[2]
    got = {r.doc_id: r for r in digest.edited(df).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[3].near_next == 0.0


def slow_edited(table):
    """(id, text) rows by plain loops: id, edited text, near_edited, near_next; rows of one id by their text's key."""
    out = []
    for i, (k, t) in enumerate(table):
        after = table[(i + 1) % len(table)][1] or ""
        t = t or ""
        n = len(t) // 2
        edit = t[: len(t) - n] + after[:n]
        out.append((k, len(t), hashlib.sha256(edit.encode()).hexdigest(), float(canon(t) == canon(edit)), float(canon(t) == canon(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_next_document_across_slices_and_repeated_rows(spark, slices):
    """Repeated rows are followed by their like but for the last; the order goes on from slice to slice and round."""
    key = "doc_id long, text string"
    table = [(k, f"text number {k * 7 % 31} of some words") for k in range(90)] + [(40, "text number 1 of some words")] * 5000 + [(None, None)] * 3
    df = spark.createDataFrame(table, key)
    down = sorted((r for r in table if r[0] is not None), key=lambda r: (-r[0], r[1])) + [r for r in table if r[0] is None]
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in digest.edited(df, slices=slices).collect()), key=str)
    plain = slow_edited(down)
    same = [r for r in got if r[0] != 40]
    assert len(got) == len(table) and len([r for r in got if r[0] == 40]) == 5001
    other = slow_edited(sorted((r for r in table if r[0] is not None), key=lambda r: (-r[0], r[1]), reverse=False))
    assert same == [r for r in plain if r[0] != 40] or {r for r in same if r[0] not in (41, None)} <= set(plain) | set(other)
    assert sum(r[4] for r in got if r[0] == 40) >= 4999


def test_edited_texts_are_compared_by_bytes(spark, monkeypatch):
    """With one key for all texts likeness and fingerprints still go by the bytes."""
    monkeypatch.setattr(digest, "keys", lambda df, canon, high, low: df.withColumns({high: F.lit(7).cast("long"), low: F.lit(8).cast("long")}))
    table = [(5, "abcd"), (4, "wxyz"), (3, "WXYZ "), (2, "ab"), (1, "abcd")]
    got = {r.doc_id: r for r in digest.edited(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    edits = {}
    for i, (k, t) in enumerate(table):
        after = table[(i + 1) % len(table)][1]
        n = len(t) // 2
        edits[k] = t[: len(t) - n] + after[:n]
        assert got[k].near_edited == float(canon(t) == canon(edits[k])) and got[k].near_next == float(canon(t) == canon(after))
    seen = {}
    for k, t in table:
        seen.setdefault(canon(t), set()).add(got[k].fingerprint)
        seen.setdefault(canon(edits[k]), set()).add(got[k].edited_fingerprint)
    assert all(len(x) == 1 for x in seen.values()) and len({y for x in seen.values() for y in x}) == len(seen)
    one = digest.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_edited == 0.0 and one.fingerprint != one.edited_fingerprint and one.near_next == 1.0


def test_fingerprints_leave_all_columns_alone(spark, monkeypatch):
    names = {k: F.lit(k) for k in ("h", "l", "n", "canon", "__h", "__l", "__canon", "__text", "met", "part", "bitmap", "clash_n")}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A ")], "doc_id long, text string").withColumns(names)
    for _ in range(2):
        rows_ = digest.fingerprints(df).collect()
        assert all(r[k] == k for r in rows_ for k in names) and len({r.fingerprint for r in rows_}) == 2
        monkeypatch.setattr(digest, "keys", lambda df, canon, high, low: df.withColumns({high: F.lit(7).cast("long"), low: F.lit(8).cast("long")}))


# 2


def slow_targets(docs):
    """Sizes, source sizes and targets by the stated rule: shares by weight, the excess shared anew until none is above."""
    size = {i: len(words(t)) for i, t in zip(docs.doc_id, docs.text)}
    of = docs.groupby("source").doc_id.apply(lambda x: sum(size[i] for i in x)).to_dict()
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(of))}
    target, rest, still = dict.fromkeys(of, 0.0), 1.5 * sum(of.values()), set(of)
    while rest > 1e-9 and still:
        share = rest / sum(weight[s] for s in still)
        rest = 0.0
        for s in sorted(still):
            target[s] += share * weight[s]
            if target[s] >= 2 * of[s]:
                rest += target[s] - 2 * of[s]
                target[s] = 2.0 * of[s]
                still.discard(s)
    return size, of, target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_matches_a_plain_computation(spark, sf):
    """Sizes, source sizes and targets of the query. Words taken miss a target by less than the source's largest document; in sources
    of 50 documents (sf0.01) by at most 12 % or half that document, 3 % on average."""
    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet")
    size, of, target = slow_targets(docs)
    got = queries.QUERIES["op2_mixing_sources"](spark, f"/root/testdata/{sf}").toPandas().set_index("doc_id")
    source = docs.set_index("doc_id").source
    assert len(got) == len(docs) and all(got["size"][i] == n for i, n in size.items())
    assert all(got.source_size[i] == of[source[i]] and abs(got.target[i] - target[source[i]]) < 1e-6 * target[source[i]] for i in got.index)
    assert all(t % max(1, got["size"][i]) == 0 and t <= 2 * got["size"][i] for i, t in got.taken.items())
    taken = got.taken.groupby(source).sum()
    biggest = got["size"].groupby(source).max()
    error = pd.Series({s: abs(taken[s] - target[s]) / target[s] for s in of})
    assert all(abs(taken[s] - target[s]) < biggest[s] + 1 for s in of)
    if sf == "sf0.01":
        assert error.mean() < 0.03 and all(abs(taken[s] - target[s]) <= max(0.12 * target[s], biggest[s] / 2) for s in of)


def test_mix(spark, docs):
    got = rows(spark, "op2_mixing_sources").merge(docs[["doc_id", "source"]], on="doc_id")
    size = docs.assign(size=[len(words(t)) for t in docs.text]).groupby("source")["size"].sum().sort_index()
    assert len(got) == len(docs) and abs(got.groupby("source").target.first().sum() - 1.5 * size.sum()) < 1e-6 * size.sum()
    assert (got.taken <= 2 * got["size"]).all() and (got.groupby("source").target.first() <= 2 * size + 1e-9).all()
    again = rows(spark, "op2_mixing_sources")
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())


def test_mix_comes_near_its_target(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pow(id % 97, 1.5) as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"))
    got = mixing.mix(df, block=256).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.002 * r.target + 60 for r in got)


@pytest.mark.parametrize("sizes", [[9, 7, 5, 4, 2, 1], [900, 3, 2, 1, 1, 1], [4, 4, 4, 4, 4, 4]])
def test_dependent_rounding_keeps_words_and_means(sizes):
    """By pairs, and by the pool where one document is too large: words stay, and each document's expected copies."""
    for p0 in (0.4, 0.73):
        total = [0.0] * 6
        for seed in range(3000):
            ids = [seed * 10 + k for k in range(6)]
            out, at, p = mixing.settle_even(ids, sizes, p0)
            done = sum(s * o for s, o in zip(sizes, out)) + (sizes[at] * p if at >= 0 else 0)
            assert abs(done - p0 * sum(sizes)) < 1e-6
            for k in range(6):
                total[k] += p if k == at else out[k]
        assert all(abs(t / 3000 - p0) < 0.05 for t in total)
    ids, own, p = [1, 2, 3], [5, 3, 8], [0.5, 0.25, 0.75]
    out, at = mixing.settle(ids, own, p)
    assert abs(sum(s * (p[k] if k == at else o) for k, (s, o) in enumerate(zip(own, out))) - (2.5 + 0.75 + 6)) < 1e-6


def test_pairs_settle_most_documents(monkeypatch):
    """In a block of like sizes the documents are paired with each other; the pool is met at the small end alone."""
    met, moved = [], mixing._moved
    monkeypatch.setattr(mixing, "_moved", lambda p, up, down, size, chance: met.append(up + down) or moved(p, up, down, size, chance))
    sizes = sorted((50 + (k * 7919) % 400 for k in range(2000)), reverse=True)
    out, at, _ = mixing.settle_even(list(range(2000)), sizes, 0.37)
    assert sum(x <= max(sizes) + 1e-6 for x in met) > 0.95 * len(met)
    assert abs(sum(s * o for s, o in zip(sizes, out)) - 0.37 * sum(sizes)) <= 450


def test_rows_alike_do_not_share_a_block(spark, monkeypatch):
    """Empty texts go by the blocks, rows alike are one unit, rows without an id are told apart by their texts."""
    rows = [(None, f"w{k} of the text", "en", "a", 0) for k in range(400)] + [(k, None if k % 2 else "", "en", "a", 0) for k in range(400)] + [(7, "one and the same", "en", "a", 0)] * 9000
    seen, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block=20).toPandas()
    rounded = next(df for df in seen if "is_open" in df.columns).groupBy("block").count().toPandas()
    assert rounded["count"].sum() == 401 and rounded["count"].max() < 60
    assert len(got) == len(rows) and not got[got["size"] == 0].copies.gt(1).any()
    assert abs((got.copies * got["size"]).sum() - got.target.iloc[0]) <= 4
    out = mixing.apply_mix(df.withColumns({"part": F.lit(1), "n": F.lit(2), "turn": F.lit(3), "before": F.lit(4)}))
    assert out.count() == got.copies.sum() and out.filter("text = 'one and the same'").count() == got[(got.doc_id == 7) & (got["size"] > 0)].copies.sum()


def test_large_ids_are_mixed_as_they_are(spark):
    ids = [2**62 + 3 * k + 1 for k in range(50)] + [None]
    got = mixing.mix(spark.createDataFrame([(i, "some words here", "", "a", 0) for i in ids], SCHEMA)).toPandas()
    assert sorted(int(x) for x in spark.createDataFrame([(str(i),) for i in ids if i], "i string").toPandas().i) == sorted(r.doc_id for r in mixing.mix(spark.createDataFrame([(i, "some words here", "", "a", 0) for i in ids[:-1]], SCHEMA)).collect())
    assert len(got) == len(ids)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and got[got["size"] == 0].copies.notna().all()
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == int(got.copies.sum())


# 3


def slow_print(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    got = rows(spark, "op3_simhash_near_dedup").set_index("doc_id")
    prints = {i: slow_print(t) for i, t in zip(docs.doc_id, docs.text)}
    assert all(got.fingerprint[i] == f"{p:016x}" for i, p in prints.items())
    want = union(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert all(got.component_id[i] == c for i, c in want.items())


@pytest.mark.parametrize("list_size", [0, 3, 64])
def test_links_at_any_list_size(spark, list_size):
    import random

    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(60)} | {0, 1, 3, 7, 1 << 63, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {x.node: x.root for x in components(simhash.links(df, list_size=list_size)).collect()}
    want = union(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2])
    assert {f: got.get(f, f) for f in signed} == want


def test_every_pair_meets_at_each_depth(spark):
    """Two fingerprints that share 6 positional bytes or more meet under 4, 5 and 6 positions; others are not retained."""
    import random

    r = random.Random(2)
    for k in (4, 5, 6):
        for _ in range(200):
            gone = r.sample(range(8), r.randint(0, 2))
            shared = [p for p in range(8) if p not in gone]
            assert tuple(shared[:k]) in simhash._choices(k)
    x, y, z = 0x0102030405060708, 0x0102030405060708 ^ (1 << 3) ^ (1 << 60), 0x0102030405060708 ^ 1 ^ (1 << 20) ^ (1 << 60)
    tally = spark.sql(f"select {simhash._tally(f'{x}L', f'{y}L')} as a, {simhash._tally(f'{x}L', f'{z}L')} as b").first()
    assert (tally.a, tally.b) == (6, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, k) for k in range(501, 560)] + [(9, 9), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[k] == 500 for k in range(501, 560)) and 0 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == len(ODD)
    zero = got[got.fp == 0]
    assert set(zero.component_id.dropna()) == {1} and len(zero) == 4
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id) == [1, 4, 7, 8, 9]


def test_keep_one_without_ids_and_with_repeated_ids(spark):
    """Copies among rows without an id go but for one; different texts under one id both stay."""
    a, b, c = ("the first text of some words", "another one that is quite different from it", "and a third which has nothing in common")
    table = [(None, a, "x"), (None, a, "x"), (None, a, "y"), (1, b, "x"), (1, c, "x"), (1, c, "x"), (None, b, "x"), (2, c, "z")]
    got = simhash.keep_one(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == sorted([(0, a), (1, b), (1, c)])


# 4 and 5


@pytest.mark.parametrize("name,label,parts,part,threshold", [("op4_toxicity", "toxic", 4, 2, 0.3), ("op5_quality_classifier", "quality", 3, 1, 0.5)])
def test_classifiers(spark, docs, name, label, parts, part, threshold):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % parts == part) for i, h in got.held_out.items())
    assert got.score.between(0, 1).all() and ((got.score >= threshold).astype(int) == got.predicted).all()
    both = got.join(pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id"), how="inner")
    held = both[both.held_out]
    assert (held[label] == held.predicted).mean() >= 0.9
    found = held[held[label] == 1].predicted.mean()
    assert found >= (0.6 if label == "toxic" else 0.95) and held[held[label] == 0].predicted.mean() <= 0.05


def test_toxicity_is_the_plain_sum_of_weights(spark, docs):
    """The query's scores by plain loops over the n-grams of each text, with the weights of the same model."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = rows(spark, "op4_toxicity").set_index("doc_id")
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    mask = 0xFFFFFFFF

    def mixed(h):
        h = ((h ^ (h >> 15)) * 0x85EBCA6B) & mask
        return h ^ (h >> 13)

    for i, t in list(zip(docs.doc_id, docs.text))[::40]:
        line, slots = f" {' '.join(t.lower().split())} ", set()
        base = []
        for k in range(len(line) - 3):
            h = 0x9E3779B1
            for c in line[k : k + 4]:
                h = ((h ^ ord(c)) * 0x01000193) & mask
            base.append(mixed(h))
        for n in toxicity.SIZES:
            counts = {}
            for k in range(len(line) - n + 1):
                h = base[k] if n == 4 else mixed((base[k] * (2 * n + 1) + base[k + n - 4]) & mask)
                counts[h] = counts.get(h, 0) + 1
            for h, c in counts.items():
                slots |= {(h if times == 1 else mixed((h + times) & mask)) % toxicity.WIDTH for times in toxicity.TIMES if c >= times}
        total = model.bias + sum(weight.get(x, 0.0) for x in slots)
        assert abs(got.score[i] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-6


def test_quality_is_the_sum_of_one_bin_of_each_table(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = rows(spark, "op5_quality_classifier").set_index("doc_id")
    place = lambda edges, v: sum(e <= v for e in edges)
    for i, t in zip(docs.doc_id, docs.text):
        x = quality.statistics(t)
        total = model.intercept + sum(table[place(e, v)] for table, e, v in zip(model.tables, model.edges, x))
        total += sum(g[place(model.coarse[a], x[a]), place(model.coarse[b], x[b])] for g, (a, b) in zip(model.grids, model.pairs))
        assert abs(got.score[i] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9


def test_labels_of_the_held_out_part_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        part = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % module.HELD_OUT[0]) == module.HELD_OUT[1]
        turned = labels.withColumn(label, F.when(part, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (sorted((r.doc_id, r.score) for r in module.score(docs, module.train(docs, x)).collect()) for x in (labels, turned))
        assert a == b


def test_classifiers_on_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, None, None), (None, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for labels in (no_labels, few):
            model = module.train(odd, labels)
            got = module.score(odd, model).toPandas()
            assert len(got) == len(ODD) and got.score.between(0, 1).all()
        assert module.score(none, model).count() == 0


def test_toxicity_of_a_text_in_parts(monkeypatch):
    """Repeats count over the whole text, and a slot has its weight once however many features fall on it."""
    whole = toxicity.features(LONG)
    table = np.random.default_rng(0).normal(size=toxicity.WIDTH).astype(np.float32)
    want = table[np.unique(whole)].sum(dtype=np.float64)
    for size in (1, 7, 1000, 1 << 14):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        some = LONG if size > 7 else LONG[:2000]
        got = toxicity.features(some)
        monkeypatch.undo()
        assert np.array_equal(got, toxicity.features(some))
    assert abs(toxicity.total(table, LONG) - want) < 1e-6


# 6


def test_rules(spark, docs):
    got = rows(spark, "op6_quality_rules").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        w, where = words(t), {}
        for j in range(len(w) - 2):
            where.setdefault(tuple(w[j : j + 3]), []).append(j)
        repeated = len({p for v in where.values() if len(v) > 1 for j in v for p in (j, j + 1, j + 2)})
        full = [x for x in t.split("\n") if words(x)]
        r = got.loc[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w)) and not (r.base_failed and r.kept)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    good = got.join(labels, how="inner").query("quality == 1 and not base_failed")
    assert good.kept.all()


def test_windows_with_one_hash_are_told_apart(spark, monkeypatch):
    """Were all hashes equal, the words would still decide."""
    text = " ".join(f"w{k}" for k in range(60)) + " a b c d a b c"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = rules.judge(df).first().n_repeat_words
    expr = F.expr
    monkeypatch.setattr(rules.F, "expr", lambda x: expr(re.sub(r"xxhash64\([^()]*\)", "7L", x)))
    assert rules.judge(df).first().n_repeat_words == want == 6


def test_rules_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE["op6_quality_rules"]).df()
    got = rows(spark, "op6_quality_rules")
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (x[cols].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all()


def test_rules_on_odd_rows(odd, none):
    got = rules.judge(odd).toPandas()
    assert len(got) == len(ODD) and got[got.n_words == 0].base_failed.all()
    good = rules.keep_good(odd)
    assert good.columns == odd.columns and good.count() == 0
    assert rules.judge(none).count() == 0 and rules.keep_good(none).count() == 0


def test_each_rule_rejects(spark):
    """A clean text, one that each rule alone rejects, and two that the base rejects."""
    clean = " ".join(f"the river{k} runs and bends{k} to sea{k} in light{k} of day{k}" for k in range(12))
    alone = {
        "symbols": clean.replace("river", "#$ river"),
        "stop_words": re.sub(r"\b(the|and|to|in|of)\b", "quix", clean),
        "exclamations": clean.replace("river", "!!!!! river!!!!!").replace("sea", "sea!!"),
        "word_length": clean + "".join(f" {chr(0x4E00 + k)}" for k in range(900)),
        "repeated_lines": clean + "".join(f"\n{k // 2}" for k in range(40)).replace("\n", "\n\u4e00") + "\nend" * 40,
    }
    base = [clean[:100], "the river runs to the sea and " * 12]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate([clean, *alone.values(), *base])], SCHEMA)
    assert [r.doc_id for r in rules.keep_good(df).collect()] == [0]
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for k, name in enumerate(alone, 1):
        without = tuple(x for x in rules.RULES if x.name != name)
        assert not got[k].base_failed and not got[k].kept, name
        measured, names = rules.measure(df.filter(f"doc_id = {k}"), rules=without)
        assert measured.first()[names["kept"]], name
    assert all(got[k].base_failed for k in range(len(alone) + 1, len(alone) + 3))


# 7


def test_secrets(spark, docs):
    got = rows(spark, "op7_secret_scans").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        want = {m.start(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
        assert {f["start"] for f in got.findings[i] if f["is_secret"]} == want


def test_forest_tells_look_alikes(spark):
    forest = secrets.train(spark)
    test = secrets.labelled_findings(300, seed=99)
    df = spark.createDataFrame([(i, f"{b}{c}{a}") for i, (b, c, a, _) in enumerate(test)], "doc_id long, text string")
    got = {r.doc_id: r.n_secrets > 0 for r in secrets.report(df, forest=forest).collect()}
    right = sum(got[i] == bool(y) for i, (*_, y) in enumerate(test))
    assert right >= 0.9 * len(test)


def findings():
    """Secrets of 17 shapes and look-alikes of 14, written apart from the generator that the forest is trained on."""
    import random

    r = random.Random(77)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up, dec, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    any_ = low + up + dec
    block = lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(any_ + "+/", 64) for _ in range(5)) + "\n-----END RSA PRIVATE KEY-----"
    secret = {
        "hex": ('token = "', lambda: some(hexa, 40), '"'), "aws id": ("AWS_ACCESS_KEY_ID=", lambda: "AKIA" + some(up + "234567", 16), ""), "aws key": ("aws_secret_access_key = ", lambda: some(any_ + "+/", 40), ""),
        "letters": ('api_key = "', lambda: some(low, 20), '"'), "short": ("token: ", lambda: f"hunter{r.randint(1, 9)}x", ""), "url": ("postgres://admin:", lambda: some(any_, 10), "@db.internal:5432/x"),
        "jwt": ("jwt ", lambda: f"eyJ{some(any_, 30)}.eyJ{some(any_, 60)}.{some(any_ + '_-', 43)}", ""), "github": ("clone with ", lambda: "ghp_" + some(any_, 36), " now"),
        "slack": ("use ", lambda: f"xoxb-{some(dec, 12)}-{some(dec, 12)}-{some(any_, 24)}", " here"), "stripe": ("", lambda: "sk_live_" + some(any_, 24), ""), "google": ("key ", lambda: "AIza" + some(any_ + "_-", 35), ""),
        "block": ("", block, ""), "bearer": ("Authorization: Bearer ", lambda: some(any_, 32), ""), "password": ("password: ", lambda: some(any_, 10), ""), "yaml": ("db_password: '", lambda: some(any_ + "!#", 14), "'"),
        "json": ('{"client_secret": "', lambda: some(any_, 32), '"}'), "mail": ("", lambda: f"SG.{some(any_, 22)}.{some(any_, 43)}", ""),
    }
    clean = {
        "commit": lambda: f"commit {some(hexa, 40)} fixed it", "uuid": lambda: "id " + "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), "card": lambda: "card " + some(dec, 16), "prose": lambda: "the password: remember to change it",
        "path": lambda: "see https://www.shop.com/items/catalogue/2024/summer-sale-9 there", "counts": lambda: "max_tokens: 4096 and n_tokens=123456", "name": lambda: "call getUserAccountById2Factory now", "author": lambda: "author: Johannes and authors: several",
        "mail": lambda: "write to john.smith1984longname77@mail.example.com", "date": lambda: "2024-01-02T10:11:12.123456 and 20240102101112", "lookup": lambda: 'token = os.environ["TOKEN"]', "word": lambda: "password: required", "snake": lambda: "test_case_number_12_of_many", "rule": lambda: "-" * 28 + "1",
    }
    rows_ = [(k, f"Some text before it. {b}", v(), f"{a} and then more text.") for k, (b, v, a) in secret.items() for _ in range(30)]
    return rows_, [(k, f"Some text before it. {g()} and then more text.") for k, g in clean.items() for _ in range(30)]


def test_recall_of_each_shape_of_secret(spark):
    """Each shape is found at least 8 times of 10, all together 95 of 100, and look-alikes are left; masks cover the whole secret."""
    secret, clean = findings()
    table = [(i, "".join(x[1:])) for i, x in enumerate(secret)] + [(len(secret) + i, x[1]) for i, x in enumerate(clean)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    right = [(k, v not in found[i]) for i, (k, b, v, a) in enumerate(secret)]
    of = lambda k: [x for n, x in right if n == k]
    shapes = sorted({k for k, _ in right})
    assert sum(x for _, x in right) >= 0.95 * len(right) and all(sum(of(k)) >= 0.8 * len(of(k)) for k in shapes), {k: sum(of(k)) for k in shapes}
    left = sum(found[len(secret) + i] == t for i, (_, t) in enumerate(clean))
    assert left >= 0.97 * len(clean)


def test_candidates_by_a_plain_search(spark, docs):
    """The query's candidates are those of the same pattern by another engine, at the same places."""
    import regex

    pattern = regex.compile(secrets.CANDIDATE.replace("\\\\", "\\"))
    got = rows(spark, "op7_secret_scans").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        want = [(m.start() + len(m[1]), len(m[0]) - len(m[1])) for m in pattern.finditer(t)] if re.search(secrets.GATE, t) else []
        assert [(f["start"], f["length"]) for f in got.findings[i]] == want


def test_redaction(spark, odd, none):
    text = 'x token = "0123456789abcdef0123456789abcdef01234567" y'
    df = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert got[1].text == 'x token = "[SECRET]" y' and got[1].n_chars == len(got[1].text) and got[2].text is None
    out = secrets.redact(odd)
    assert out.columns == odd.columns and sorted(str(r.text) for r in out.collect()) == sorted(str(r[1]) for r in ODD)
    assert secrets.report(odd).count() == len(ODD) and secrets.report(none).count() == 0


# 8 and 10


def test_bpe(spark, docs):
    got = rows(spark, "op8_byte_level_bpe").set_index("doc_id")
    enc = bpe.encoding()
    for i, t in zip(docs.doc_id, docs.text):
        ids = enc.encode_ordinary(t)
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest()


def test_long_texts_are_cut_at_safe_places(docs):
    enc = bpe.encoding()
    text = "\n \n".join(docs.text) + "   \n\n  end 12's   "
    for size in (1, 7, 1000):
        assert "".join(bpe.pieces(text, size)) == text
        assert [i for p in bpe.pieces(text[:20000], size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text[:20000])
    signs = "word!\x1c\x1d\x1e\x1f end \x85\u2003" * 3000
    assert bpe.encode(signs, enc) == enc.encode_ordinary(signs)
    signs = "!\x1c" * 40000
    assert bpe.encode(signs, enc) == enc.encode_ordinary(signs)
    assert tiktoken.__version__ and bpe.PATTERN == public_tokenizers.PATTERN


def test_long_runs_of_each_kind(spark):
    """Two million characters of one kind are encoded; runs of white space as the pattern would have them."""
    import random

    enc, r = bpe.encoding(), random.Random(3)
    for _ in range(30):
        text = "".join(r.choice([" ", "  ", "\n", "\t", " \n ", "a", "b ", "'s", "12", "!", "\x1c", "\u3000", "\x85", "é", " x"]) for _ in range(300)) * 120
        assert bpe.encode(text, enc, 2) == bpe.encode(text, enc) == enc.encode_ordinary(text)
    table = [(k, f"word{c * (2_000_000 // len(c))}{end}") for k, (c, end) in enumerate((c, end) for c in (" ", "\n", " \n\t\u3000", "x", "!", "1", "漢") for end in ("a", ""))]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in bpe.digests(df).collect()}
    assert all(got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for k, t in table)
    assert got[0].n_tokens == len(enc.encode_ordinary("word")) + 1_999_999 + len(enc.encode_ordinary(" a"))
    counts = {x.doc_id: x.n_tokens for x in tokens.token_counts(df).collect()}
    assert counts == {k: x.n_tokens for k, x in got.items()}


def test_bpe_on_odd_rows(odd, none):
    got = bpe.digests(odd).toPandas()
    assert len(got) == len(ODD) and got.n_tokens.min() == 0
    want = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ODD)
    assert sorted(got.decoded_sha256) == want and bpe.digests(none).count() == 0


def test_token_counts(spark, docs):
    got = rows(spark, "op10_token_counts").set_index("doc_id")
    enc = bpe.encoding()
    for i, t in zip(docs.doc_id, docs.text):
        starts, at, want = tokens.lines(t), 0, None
        want = [0] * len(starts)
        for token in enc.encode_ordinary(t):
            char = len(t.encode()[:at].decode("utf-8", "ignore"))
            want[sum(s <= char for s in starts) - 1] += 1
            at += len(enc.decode_bytes([token]))
        assert list(got.section_tokens[i]) == want and got.n_tokens[i] == sum(want)


def test_token_counts_of_fields(spark):
    """Fields and text, encoded as one document, by plain attribution of each token to where it starts."""
    table = [(1, "src 1", "Two lines\nof text"), (2, None, "  begins with blanks"), (3, "x", None), (4, "end ", "\n\nlines"), (5, "", "")]
    df = spark.createDataFrame(table, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in tokens.token_counts(df, fields=("source",)).collect()}
    enc = bpe.encoding()
    for k, source, text in table:
        head = f"{source or ''}\n"
        at, want = 0, [0, 0]
        for token in enc.encode_ordinary(head + (text or "")):
            want[at >= len(head.encode())] += 1
            at += len(enc.decode_bytes([token]))
        assert list(got[k].field_tokens) == want and got[k].n_tokens == len(enc.encode_ordinary(text or ""))


def test_boundary_rules():
    import numpy as np

    first, last, starts = np.array([0, 3, 8]), np.array([2, 9, 9]), np.array([0, 4, 9])
    assert tokens.attribute(first, last, starts, "start").tolist() == [0, 0, 1]
    assert tokens.attribute(first, last, starts, "end").tolist() == [0, 2, 2]
    assert tokens.attribute(first, last, starts, "most").tolist() == [0, 1, 1]


def test_token_counts_on_odd_rows(odd, none):
    got = tokens.token_counts(odd, rule="most").toPandas()
    assert len(got) == len(ODD) and (got.n_tokens == [sum(x) for x in got.section_tokens]).all() and got.n_sections.min() == 1
    assert tokens.token_counts(none).count() == 0
    with pytest.raises(ValueError):
        tokens.token_counts(odd, rule="other")


# 9

URLS = [
    ("http://A.COM/x?y", "a.com", "/x", "com/", "allow"), ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"), ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://b.net/en", "b.net", "/en", None, "allow"),
    ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://?q", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://com", "com", "", None, "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(URLS))] == [u[1:] for u in URLS]
    assert urls.judge(df.limit(0)).count() == 0


def link(h):
    return f'<a href="http://{h}/p">x</a>'


def test_distrust_goes_against_links(spark):
    """Hosts of a table of seeds are blocked, and so is who links to them, but not who is linked by trusted hosts."""
    pages = [("http://junk.org/", ""), ("http://feeds.org/", link("junk.org")), ("http://fine.org/", link("good.org")), ("http://ok.com/", link("fine.org")), ("http://m.junk.org/", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("JUNK.org", "distrust", 1.0), (None, "trust", 1.0), ("fine.org", "other", 1.0)], "host string, kind string, weight double")
    got = {r.host: r.verdict for r in urls.judge(df, seeds=seeds).collect()}
    assert got == {"junk.org": "block", "feeds.org": "block", "fine.org": "allow", "ok.com": "allow", "m.junk.org": "block"}
    assert {r.verdict for r in urls.judge(df).collect()} == {"allow"}


def slow_verdicts(pages):
    """page_id -> host, path, rule, verdict by plain loops: rules, seeds from them, PageRank with what is lost going back to the seeds."""
    rules_ = [(r.verdict, r.host, r.path) for r in urls.RULES]
    fits = lambda host, path: max(((len(h + p), h + p, v) for v, h, p in rules_ if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    out, of, edges = {}, {}, {}
    for k, u, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        _, rule, verdict = fits(host, path)
        out[k] = [host, path, rule, verdict]
        if host:
            of.setdefault(host, []).append(verdict == "block")
            for dst in re.findall(r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or ""):
                if dst.lower() != host:
                    edges[host, dst.lower()] = edges.get((host, dst.lower()), 0) + 1
    for host in of:
        up = host.partition(".")[2]
        if "." in up and up in of:
            for e in ((host, up), (up, host)):
                edges[e] = edges.get(e, 0) + 1
    bad = {h: sum(x) / len(x) for h, x in of.items() if sum(x) / len(x) > 0.5}
    good = {h: 1.0 for h in of if h not in bad and (h == "com" or h.endswith(".com"))}

    def rank(seeds, links):
        total = sum(seeds.values())
        start = {h: w / total for h, w in seeds.items()}
        now, all_ = dict(start), {}
        for (a, _), n in links.items():
            all_[a] = all_.get(a, 0) + n
        for _ in range(400 if seeds else 0):
            new = {}
            for (a, b), n in links.items():
                new[b] = new.get(b, 0) + 0.85 * now.get(a, 0) * n / all_[a]
            lost = 0.85 * sum(x for h, x in now.items() if h not in all_)
            for h, x in start.items():
                new[h] = new.get(h, 0) + (0.15 + lost) * x
            now = new
        return now

    trust, distrust = rank(good, edges), rank(bad, {(b, a): n for (a, b), n in edges.items()})
    for row in out.values():
        t, d = trust.get(row[0], 0), distrust.get(row[0], 0)
        row[3] = row[3] or ("block" if d > 0.5 * (t + d) else "allow")
    return {k: tuple(v) for k, v in out.items()}


def test_urls_match_plain_loops(spark, tmp_path):
    """The query, on the given pages and on some whose hosts link to each other, against plain loops."""
    import random

    given = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.QUERIES["op9_url_filters"](spark, "/root/testdata/sf0.01").collect()}
    assert got == slow_verdicts(list(zip(given.page_id, given.url, given.html)))
    r = random.Random(4)
    hosts = [f"h{k}.{end}" for k in range(25) for end in ("net", "com", "org")] + [f"m.h{k}.org" for k in range(5)]
    pages = [(i, f"http://{r.choice(hosts)}/{r.choice(['es', 'fr', 'en'])}/{i}", "".join(" " + link(r.choice(hosts)) for _ in range(r.randint(0, 4)))) for i in range(400)]
    pages += [(1000 + k, f"http://h{k}.net/es/{j}", "") for k in range(12) for j in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in queries.QUERIES["op9_url_filters"](spark, str(tmp_path)).collect()}
    want = slow_verdicts(pages)
    assert got == want
    by_method = [v for v in want.values() if v[2] is None]
    assert any(v[3] == "block" and not v[0].endswith(".net") for v in by_method) and any(v[3] == "allow" for v in by_method)


def test_block_rules_seed_distrust(spark):
    """Without a blocklist, a host most of whose pages are ruled out is distrusted, and so is who links to it."""
    pages = [("http://bad.net/es/1", ""), ("http://bad.net/fr/1", ""), ("http://bad.net/en", ""), ("http://feeds.org/", link("bad.net")), ("http://half.net/es/1", ""), ("http://half.net/en", ""), ("http://spam-farm.org/", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = [r.verdict for r in urls.judge(df).orderBy("page_id").collect()]
    assert got == ["block", "block", "block", "block", "block", "allow", "allow"]


def test_page_rank_matches_power_iteration(spark):
    edges = [("trust", "a", "b", 2), ("trust", "a", "c", 1), ("trust", "b", "c", 1), ("trust", "c", "a", 1)]
    got = {r.host: r["rank"] for r in urls.propagate(spark.createDataFrame(edges, "kind string, src string, dst string, n long"), spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, start double"), rounds=5).collect()}
    rank = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(5):
        rank = {"a": 0.85 * rank["c"] + 0.15, "b": 0.85 * rank["a"] * 2 / 3, "c": 0.85 * (rank["a"] / 3 + rank["b"])}
    assert all(abs(got.get(h, 0) - x) < 1e-9 for h, x in rank.items())


def test_page_rank_converges(spark):
    """Distrust reaches a host however many links from the seed, and ranks are those of many more rounds."""
    n = 30
    edges = [("distrust", f"h{i}", f"h{i + 1}", 1) for i in range(n)]
    got = {r.host: r["rank"] for r in urls.propagate(spark.createDataFrame(edges, "kind string, src string, dst string, n long"), spark.createDataFrame([("distrust", "h0", 1.0)], "kind string, host string, start double")).collect()}
    whole = 1 - 0.85 ** (n + 1)
    assert len(got) == n + 1 and all(abs(got[f"h{i}"] - 0.15 * 0.85**i / whole) < 1e-6 for i in range(n + 1))


def test_large_ids_keep_their_order(spark):
    ids = [2**62 + 3 * k for k in range(40)] + [-(2**61) + k for k in range(40)]
    df = spark.createDataFrame([(i, f"text of {k}", "", "", 0) for k, i in enumerate(ids)], SCHEMA)
    text = {i: f"text of {k}" for k, i in enumerate(ids)}
    down = sorted(ids, reverse=True)
    after = dict(zip(down, [*down[1:], down[0]]))
    for r in digest.edited(df).collect():
        t, k = text[r.doc_id], len(text[r.doc_id]) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + text[after[r.doc_id]][:k]).encode()).hexdigest()
