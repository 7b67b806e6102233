"""Conversion, images, scores, reports, settings files, and safety of callers' columns."""

import json
import io
import random
import re
import struct
import sys
import unicodedata
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import native, relations, research, scoring
from loomtext.plans import passes, service
from loomtext.sources import conversion, files, sinks

TEXT = "This is a sentence of some length that was read from an image, and it is kept."


def png(width, height, size=600):
    body = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body)) + random.Random(width).randbytes(size)


def pack(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


REL = '<Relationship Id="{0}" Type="t" Target="media/{1}"/>'
DOCX = pack(
    {
        "word/document.xml": '<w:document><w:p ><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p ><w:r><w:t>one</w:t></w:r><a:blip r:embed="r2"/></w:p>'
        "<w:tbl ><w:tr ><w:tc ><w:p ><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc ><w:p ><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr ><w:tc ><w:p ><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        '<w:p ><a:blip r:embed="r1"/></w:p></w:document>',
        "word/_rels/document.xml.rels": REL.format("r1", "x.png") + REL.format("r2", "y.png"),
        "word/media/x.png": png(300, 300), "word/media/y.png": png(400, 400), "word/media/z.png": png(500, 500), "word/media/small.png": png(40, 400),
    }
)
PPTX = pack({f"ppt/slides/slide{k}.xml": f'<p:sld ><a:p ><a:t>s{k}</a:t></a:p><a:blip r:embed="r"/></p:sld>' for k in (2, 10)} | {f"ppt/slides/_rels/slide{k}.xml.rels": f'<Relationship Id="r" Target="../media/i{k}.png"/>' for k in (2, 10)} | {f"ppt/media/i{k}.png": png(300 + k, 300) for k in (2, 10)})
XLSX = pack(
    {
        "xl/sharedStrings.xml": "<sst><si ><t>name</t></si><si ><t>n</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x|y</t></is></c><c r="C2"><v>7</v></c></row>',
    }
)
PDF = (
    b"%PDF-1.4\n1 0 obj\n<</Type /Page /Resources <</XObject <</Im1 4 0 R>>>>>>\nendobj\n2 0 obj\n<</Type /Page /Resources 3 0 R>>\nendobj\n3 0 obj\n<</XObject <</Im2 5 0 R>>>>\nendobj\n"
    + b"4 0 obj\n<</Subtype /Image /Width 100 /Height 90 /BitsPerComponent 8 /Filter /FlateDecode>>\nstream\n" + zlib.compress(random.Random(1).randbytes(27000)) + b"\nendstream\nendobj\n"
    + b"5 0 obj\n<</Subtype /Image /Width 300 /Height 200 /Filter /DCTDecode>>\nstream\n\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 200, 300) + b"j" * 600 + b"\nendstream\nendobj\n"
)


def test_office_files():
    assert files.to_text("a.docx", DOCX) == "## Head\n\none\n\n| a | b |\n| --- | --- |\n| 1 |  |"
    assert files.to_text("a.pptx", PPTX) == "s2\n\ns10"
    assert files.to_text("a.xlsx", XLSX) == "## Sheet 1\n\n| name |  | n |\n| --- | --- | --- |\n| x\\|y |  | 7 |"


def test_images_say_where_they_are():
    assert [x[:2] for x in files.images_of("a.docx", DOCX)] == [("Paragraph 2", "y.png"), ("Paragraph 3", "x.png"), ("Image 4", "z.png")]
    assert [x[:2] for x in files.images_of("a.pptx", PPTX)] == [("Slide 1", "i2.png"), ("Slide 2", "i10.png")]
    found = files.images_of("a.pdf", PDF)
    assert [x[:2] for x in found] == [("Page 1", "Im1"), ("Page 2", "Im2")]
    assert files.image_size(found[0][2]) == (100, 90) and files.image_size(found[1][2]) == (300, 200)
    assert files.image_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9) and files.image_size(b"no image") is None


def test_image_texts_in_order(spark):
    rows = spark.createDataFrame([("1", k, f"Image {k}", f"text {k}") for k in range(1, 12)], "file_id string, nth int, position string, text string")
    merged = files.merge_ocr(spark.createDataFrame([("1", "M")], "file_id string, markdown string"), rows).first().markdown
    assert re.findall(r"\(Image (\d+)\)", merged) == [str(k) for k in range(1, 12)]


def test_whole_documents_are_read(spark):
    rows = spark.createDataFrame([("1", "a.pdf", PDF), ("2", "b.png", png(300, 300)), ("3", "c.txt", b"x"), ("4", "d.pdf", b"%PDF")], "file_id string, name string, data binary")
    got = {r.file_id: r for r in files.whole_ocr(rows, lambda b: f"{len(b) > 1000}").collect()}
    assert got["1"].markdown == "<!-- Page 1 -->\nTrue\n\n<!-- Page 2 -->\nFalse" and got["2"].markdown == "False"
    assert "txt" in got["3"].warning and got["4"].warning == "no image to read" and got["1"].warning is None


def test_conversion_end_to_end(spark):
    table = [
        ("1", "a.html", b"<h1>T</h1><p>" + b"word and more " * 20 + b"</p>", None, None), ("2", "scan.pdf", PDF, None, None), ("3", "a.docx", DOCX, "general_document", None),
        ("4", "p.html", b"<p>paper</p>", "research_paper", None), ("5", "x.bin", b"x", None, None), ("6", "q.html", b"<p>other</p>", "research_paper", "general"),
    ]
    rows = spark.createDataFrame(table, "file_id string, name string, data binary, document_type string, extractor_override string")

    def paper(name, data):
        if name == "p.html":
            raise ValueError("no paper")
        return "paper"

    got = {r.file_id: r for r in conversion.end_to_end(rows, "safe", read=lambda b: TEXT, research=paper).collect()}
    assert got["1"].markdown.startswith("# T") and got["1"].extractor == "general" and got["1"].word_count > 40 and not got["1"].ocr_used
    assert got["2"].success and got["2"].ocr_used and got["2"].markdown.startswith("<!-- Page 1 -->") and got["2"].error is None
    assert got["3"].ocr_used is False and got["3"].n_images == 3 and "(Paragraph 2)" in got["3"].markdown
    assert got["4"].extractor == "research->general" and got["6"].extractor == "general"
    assert not got["5"].success and got["5"].error and got["5"].optimized_markdown == "" and got["5"].percent_saved == 0.0
    plain = {r.file_id: r for r in conversion.converted(rows, read=lambda b: TEXT, ocr_mode="disabled").collect()}
    assert not plain["2"].success and plain["3"].n_images == 0
    with pytest.raises(ValueError):
        conversion.converted(rows, ocr_mode="other")
    with pytest.raises(ValueError):
        conversion.batch(rows, most=5)
    assert conversion.batch(rows, "safe").count() == 6


def test_settings_file_and_discovery(tmp_path, monkeypatch):
    path = tmp_path / "p.yaml"
    path.write_text("pass_order: [ocr_cleanup, citation_removal]\npass_configs:\n  citation_removal: {enabled: false}\nfail_fast: true\n")
    made = service.from_yaml(str(path))
    assert made.enabled() == ["ocr_cleanup"] and made.fail_fast
    path.write_text("- a\n")
    with pytest.raises(passes.PipelineConfigError):
        service.from_yaml(str(path))
    package = tmp_path / "found_passes"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "one.py").write_text("from loomtext.plans import passes\npasses.register(passes.Pass('found_one', '', 1, {}, edit=lambda t, p, k: (t, k, {})))\n")
    (package / "_hidden.py").write_text("raise RuntimeError('imported')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        assert service.discover("found_passes") == ["found_one"]
        with pytest.raises(passes.DuplicatePassError):
            passes.register(passes.get("found_one"))
    finally:
        passes.unregister("found_one")
        sys.modules.pop("found_passes.one", None)
    with pytest.raises(passes.PassNotFoundError):
        passes.get("found_one")


def test_report_of_thirteen_fields(spark):
    docs = spark.createDataFrame([(1, "# T\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\nSome text [1] here."), (2, "")], "doc_id long, content string")
    got = {r.doc_id: r.report for r in service.v2_report(docs).collect()}
    assert len(got[1]) == 13 and got[1].tablesTransformed == 1 and {m.name for m in got[1].passMetrics} == set(passes.V2_ORDER)
    assert got[2].reductionPercent == 0.0 and got[2].passedValidation


def test_scores_of_trivial_pairs(spark):
    rows = spark.createDataFrame([(1, "", "x"), (2, "x y", " "), (3, "same text", "same text"), (4, None, None), (5, "a b c d", "a b c")], "doc_id long, original string, optimized string")
    got = {r.doc_id: r for r in scoring.score(rows).collect()}
    assert [got[k].overall_preservation for k in (1, 2, 3, 4)] == [100.0, 0.0, 100.0, 100.0] and got[3].method == "exact" and got[5].method == "bow"
    recall = spark.createDataFrame([(5, 80.0, 2)], "doc_id long, semantic_score double, low_chunks long")
    got = {r.doc_id: r for r in scoring.score(rows, recall).collect()}
    assert got[5].semantic_preservation == 80.0 and got[5].method == "embeddings" and any("2 chunks" in i.message for i in got[5].issues)


def test_columns_of_callers_stay(spark):
    extra = {"__oh": F.lit(1), "__mine": F.lit(2), "__before": F.lit(3), "__n": F.lit(4)}
    rows = spark.createDataFrame([(1, "# A\n\ntext 12", "text")], "doc_id long, original string, optimized string").withColumns(extra)
    got = scoring.scores(rows).first()
    assert (got["__oh"], got["__mine"], got["__before"], got["__n"]) == (1, 2, 3, 4)
    done = passes.run(rows.withColumn("content", F.col("original")), passes.Pipeline(("ocr_cleanup", "global_paragraph_deduplication"))).first()
    assert done["__before"] == 3 and done["__oh"] == 1
    assert sinks.newest(rows, "doc_id", "original").first()["__n"] == 4


def test_figures_and_titles():
    text = "Figure 1 a\nFigure 2 b\nFigure 3 c"
    assert research.collapse_figures("no figure here") == "no figure here"
    assert research.collapse_figures(text) == "Figure 1 a\n[... 1 figures omitted ...]\nFigure 3 c"
    kept = "# Ethics of machines\n\ntext\n\n# Ethics Statement\n\ngone\n\n# Supplementary Data\n\ngone\n\n# Supplementary thoughts\n\nstays\n"
    new, applied = research.optimize(kept, "aggressive")
    assert "Ethics of machines" in new and "thoughts" in new and "gone" not in new and {"remove_metadata", "remove_supplementary"} <= set(applied)


def slow_heading_dedup(text):
    out, seen = [], set()
    for row in text.split("\n"):
        if re.match(r"[ \t]*#\s", row):
            seen = set()
        bare = row.strip()
        if re.match(r"#{1,6}\s+\S", bare):
            if bare in seen:
                continue
            seen.add(bare)
        out.append(row)
    return "\n".join(out)


def slow_repeats(text, least=3, most=80):
    rows = text.split("\n")
    count = {}
    for r in rows:
        count[r.strip()] = count.get(r.strip(), 0) + 1
    out, seen = [], set()
    for r in rows:
        b = r.strip()
        if b and len(b) <= most and count[b] >= least and not re.match(r"#{1,6}\s+", b) and b in seen:
            continue
        seen.add(b)
        out.append(r)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def test_line_edits_against_plain_loops(spark):
    r = random.Random(6)
    rows = ["# A", "## B", " ## B", "## C", "text", "other", " text", "", "x" * 90, "### D ", "last"]
    texts = ["\n".join(r.choice(rows) for _ in range(r.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    got = {x.doc_id: x.c for x in df.select("doc_id", native.heading_dedup(F.col("content")).alias("c")).collect()}
    assert all(got[i] == slow_heading_dedup(t) for i, t in enumerate(texts))
    p = passes.get("content_boilerplate").settings({"remove_toc": False, "remove_certificates": False, "remove_eval_sheets": False, "remove_page_numbers": False})
    for least in (2, 3, 5):
        steps = native.content_boilerplate(p | {"min_repeat_count": least})
        now = df
        for step in steps:
            now = now.withColumn("content", step(F.col("content")))
        got = {x.doc_id: x.content for x in now.collect()}
        assert all(got[i] == slow_repeats(t, least) for i, t in enumerate(texts))


def test_paragraph_marks_are_paired_in_blocks(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(12)]
    marks = [(d, k, r.choice(base) ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 9)))) for d in range(3) for k in range(90)]
    df = spark.createDataFrame(marks, "doc_id long, para_idx int, simhash long")
    want = {(d, i, j) for d, i, x in marks for e, j, y in marks if d == e and i < j and (x ^ y).bit_count() <= 12}
    for block in (7, 256):
        got = [(x.doc_id, x.a, x.b) for x in relations.simhash_pairs(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_and_sampled(spark):
    rows = spark.createDataFrame([(k, 0, [float(k == 0), float(k)]) for k in range(5)], "vec_id long, label int, embedding array<double>")
    assert [(x.a, x.b) for x in relations.nearest(rows, 1).orderBy("a").collect()] == [(0, 1), (1, 4), (2, 4), (3, 4), (4, 3)]
    windows = spark.createDataFrame([(d, k, f"w{k % 60}", 300_000 if d else 10) for d in (0, 1) for k in range(100)], "doc_id int, chunk_idx int, chunk string, chars int")
    got = {d: [x.chunk_idx for x in scoring.sampled(windows).filter(F.col("doc_id") == d).collect()] for d in (0, 1)}
    assert len(got[0]) == 100 and 40 <= len(got[1]) <= 58 and set(range(20)) <= set(got[1])


def test_markdown_files_and_orphans(spark, tmp_path):
    docs = spark.createDataFrame([("a.html", "# A\n\ntext"), ("b.docx", "B")], "name string, content string")
    sinks.write_markdown(docs, f"file://{tmp_path}/out")
    text = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("name=*/*.txt")}
    assert text == {"name=a.md": "# A\n\ntext\n", "name=b.md": "B\n"}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/out")
    assert sinks.orphans(listed).count() == 0
    old = sinks.orphans(listed, "current_timestamp() + interval 1 day")
    assert sinks.delete(spark, old) == 2 and not list((tmp_path / "out").glob("name=*/*.txt"))


def test_names_are_free(spark):
    df = spark.range(1).withColumn("__n", F.lit(1)).withColumn("__N1", F.lit(2))
    assert T.free_name(df, "n") == "__n2"


def test_the_report_tells_what_was_removed(spark):
    text = "# Paper\n\nSee [1] and (Smith et al., 2010), not `[2]`.\n\nThis paragraph stands here more than once.\n\nThis paragraph stands here more than once.\n\n# Acknowledgements\n\nThanks.\n\n# References\n\n[1] A. Author, 2010.\n[2] B. Author, 2011."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, content string").withColumn("original_content", F.col("content"))
    order = ("reference_section_removal", "boilerplate_section_removal", "citation_removal", "global_paragraph_deduplication")
    done = passes.run(docs, passes.Pipeline(order))
    said = {r.doc_id: json.loads(r.content_removed) for r in passes.report(done).collect()}
    assert said[1] == {
        "citations": {"mode": "remove", "total_removed": 2, "numeric_bracket": 1, "author_year": 1, "protected_zones_skipped": 1},
        "reference_sections": {"mode": "remove", "sections_found": 1, "total_entries": 2, "lines_affected": 4},
        "boilerplate_sections": {"mode": "remove", "sections_found": 1, "groups_found": {"acknowledgements": 1}, "lines_affected": 3},
        "duplicate_paragraphs": {"mode": "normalized", "paragraphs_scanned": 2, "duplicates_removed": 1, "duplicate_groups": 1},
    }
    assert said[2]["citations"]["total_removed"] == said[3]["citations"]["total_removed"] == 0 and "headers_footers" not in said[3]
    details = json.loads(done.filter("doc_id = 1").first().history[0].details)
    assert details == {"mode": "remove", "sections": [{"heading": "# References", "level": 1, "group": "references", "start_line": 12, "end_line": 16, "content_lines": 2, "entry_count": 2}]}
    found = json.loads(done.filter("doc_id = 1").first().history[2].details)
    assert found["examples"] == [{"text": "[1]", "type": "numeric"}, {"text": "(Smith et al., 2010)", "type": "author_year"}]
    kept = passes.content_removed(F.col("history"))
    keep = passes.run(docs, passes.Pipeline(("reference_section_removal",), {"reference_section_removal": {"mode": "keep"}})).select("doc_id", kept.alias("said"))
    assert json.loads(keep.filter("doc_id = 1").first().said)["reference_sections"] == {"mode": "keep", "sections_found": 1, "total_entries": 2, "lines_affected": 4}


def test_vectors_of_one_large_group_are_compared_in_blocks(spark):
    draw = random.Random(5)
    vectors = [(k, 0 if k % 3 else k % 2, [draw.uniform(-1, 1) for _ in range(4)]) for k in range(60)] + [(60, None, [1.0] * 4)]
    rows = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")
    whole = {tuple(r) for r in relations.similar_vectors(rows, 0.5).collect()}
    assert whole and whole == {tuple(r) for r in relations.similar_vectors(rows, 0.5, block=7).collect()}
    near = sorted(map(tuple, relations.nearest(rows, 5).collect()))
    assert near == sorted(map(tuple, relations.nearest(rows, 5, block=7).collect()))
    assert relations.similar_vectors(rows.limit(0), 0.5).count() == 0


def test_character_repair_against_the_standard_library(spark):
    r = random.Random(11)
    pool = "abcXYZ 0129é́  ﬁﬃＡ～²①Åẛ̣­​‍﻿㈱가가日本😀ß"
    texts = ["x" + "".join(r.choice(pool) for _ in range(r.randint(0, 60))) + "x" for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (300, None), (301, "")], "doc_id long, content string")
    got = {x.doc_id: x.content for x in service.cleaned(df).collect()}
    want = [unicodedata.normalize("NFKC", t).translate(dict.fromkeys(map(ord, T.INVISIBLE))) for t in texts]
    assert [got[i] for i in range(300)] == want and not got[300] and got[301] == ""


@pytest.mark.parametrize(
    "text, given, want",
    [
        ("ﬁne ﬄuent Æsop œuvre", {}, "fine ffluent AEsop oeuvre"),
        ("a\x01b\x7fc\td", {}, "abc\td"),
        ("a\x01b", {"remove_control_chars": False}, "a\x01b"),
        ("“Hi” ‘x’ – y", {"normalize_quotes": True}, "\"Hi\" 'x' - y"),
        ("“Hi” ‘x’ – y", {}, "“Hi” ‘x’ – y"),
        ("word , here.. end... so", {}, "word, here. end... so"),
        ("word , here.. end", {"fix_punctuation": False}, "word , here.. end"),
        ("the (cid:12)value `(cid:3)`", {}, "the value `(cid:3)`"),
        ("ＡＢ ²", {}, "AB 2"),
    ],
)
def test_character_repair_by_switch(spark, text, given, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    done = passes.run(df, passes.Pipeline(("ocr_cleanup",), {"ocr_cleanup": given})).first()
    assert done.content == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Title\n\nTable of Contents\nIntroduction ........ 1\n2.1 Method and data 14\n\nThe text begins.", "# Title\n\nThe text begins."),
        ("# Title\n\n## Contents\n\nIntroduction ........ 1\n\nThe text begins.", "# Title\n\nThe text begins."),
        ("# Title\n\n```\nContents\nIntroduction ........ 1\n```\n\nThe text begins.", None),
    ],
)
def test_contents_lists_go(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    assert passes.run(df, passes.Pipeline(("content_boilerplate",))).first().content == (want or text)


@pytest.mark.parametrize("heading", ["References\n==========", "References\n----------", "REFERENCES"])
def test_underlined_and_plain_headings_of_references(spark, heading):
    df = spark.createDataFrame([(1, f"Body of the text.\n\n{heading}\n\n[1] A. Author, 2010.\n[2] B. Author, 2011.")], "doc_id long, content string")
    assert passes.run(df, passes.Pipeline(("reference_section_removal",))).first().content == "Body of the text."
