"""The corpus pipeline, stage by stage, against plain versions."""

import itertools
import os
import re

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bpe, common
from loomtext.llm.simhash import fingerprint

from test_operators import ODD, SCHEMA, union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        result.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs.toPandas())
    return [pd.read_parquet(f"{SF}/documents.parquet"), *out]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]


def test_rules_keep_good_documents(stages):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    kept = set(stages[1].doc_id)
    gone = stages[0][~stages[0].doc_id.isin(kept)]
    for i, t in zip(gone.doc_id, gone.text):
        assert len(t.split()) < 50 or i not in labels.index or labels.quality[i] == 0 or len(set(t.split())) < 0.7 * len(t.split())


def test_one_of_each_group_stays(stages):
    before = {i: fingerprint(t) for i, t in zip(stages[1].doc_id, stages[1].text)}
    kept = sorted(stages[2].doc_id)
    assert all((before[a] ^ before[b]).bit_count() > 2 for a in kept for b in kept if a < b)
    least = union(before, [(a, b) for a, b in itertools.combinations(before, 2) if (before[a] ^ before[b]).bit_count() <= 2])
    assert kept == sorted(set(least.values()))


def test_secrets_are_masked(stages):
    assert sorted(stages[3].doc_id) == sorted(stages[2].doc_id)
    assert not any(re.search(r"\b[0-9a-fA-F]{40}\b", t) for t in stages[3].text)
    old = stages[2].set_index("doc_id").text
    for i, t, n in zip(stages[3].doc_id, stages[3].text, stages[3].n_chars):
        assert n == len(t) and (t == old[i] or "[SECRET]" in t)


def test_copies_and_tokens(stages):
    n = stages[4].doc_id.value_counts()
    assert n.max() <= 2 and sorted(stages[5].doc_id) == sorted(stages[4].doc_id)
    text, enc = stages[4].drop_duplicates("doc_id").set_index("doc_id").text, bpe.encoding()
    assert all(len(enc.encode_ordinary(text[i])) == k for i, k in zip(stages[5].doc_id, stages[5].n_tokens))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert got[key].sort_values(key).values.tolist() == stages[5][key].sort_values(key).values.tolist()


def test_stages_on_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, and no rows at all, through every stage."""
    good = " ".join(f"the river{k} runs and bends{k} to sea{k} in light{k} of day{k}" for k in range(12))
    other = " ".join(f"und der berg{k} mit stein{k} ist von eis{k} auf land{k}" for k in range(14))
    table = [*ODD, (20, good, "en", None, 1), (20, good, "en", None, 1), (20, other, "de", "b", None), (None, other, None, "b", 2), (21, (good + "\n") * 3, "en", "a", 5)]
    extra = {k: F.lit(k) for k in ("h", "l", "n", "fp", "size", "copies", "part", "turn", "kept", "w", "t", "__h", "__text", "flag", "component_id", "findings", "Z")}
    docs = spark.createDataFrame(table, SCHEMA).withColumns(extra)
    for start in (docs, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            whole, now = stage(spark, start, SF), stage(spark, now, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert whole.columns == now.columns == docs.columns and all(r[c] == c for r in whole.collect() for c in extra)
            if start is not docs:
                assert whole.count() == now.count() == 0
        if start is docs:
            assert {r.doc_id for r in now.collect()} <= {20, 21, None}


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = corpus_pipeline.run(spark, SF)
    (own,) = os.listdir(tmp_path)
    assert os.listdir(tmp_path / own) == [str(len(corpus_pipeline.STAGES) - 2)] and got.count() > 0


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), spark.conf

    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        with pytest.raises(ValueError):
            common.shared_folder(Session())
    assert common.shared_folder(spark)
