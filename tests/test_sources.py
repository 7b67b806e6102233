"""Files, archives, images, registries and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from loomtext.sources import files, sinks
from loomtext.streaming import ingest


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), data)
    return out.getvalue()


def test_upload_and_archive(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive(b_md=b"# B", a_txt=b"A", x_exe=b"no"))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    up = files.uploads(spark, str(tmp_path))
    assert {r.name: r.error for r in up.collect()} == {"a.zip": None, "bad.zip": None}
    assert {r.error for r in files.uploads(spark, str(tmp_path), limit=5).collect()} == {"file too large"}
    got = files.members(up.filter("name like '%.zip'")).collect()
    assert sorted((r.member, bytes(r.data)) for r in got if r.error is None) == [("a.txt", b"A"), ("b.md", b"# B")]
    assert sum(r.error is not None for r in got) == 1


def test_convert_falls_back(spark):
    rows = spark.createDataFrame([("1", "a.html", b"<h1>T</h1><p>x <b>y</b></p><ul><li>i</li></ul>"), ("2", "b.pdf", b"%PDF")], "file_id string, name string, data binary")
    got = {r.file_id: r for r in files.convert(rows).collect()}
    assert got["1"].markdown == "# T\n\nx **y**\n\n- i" and not got["2"].success and "pdf" in got["2"].error
    assert {r.file_id: r.extractor for r in files.convert(rows, fallback=lambda n, d: "ok").collect()}["2"] == "general->fallback"


def test_images_are_read_once(spark):
    big = b"x" * 600
    rows = spark.createDataFrame([("1", "a.docx", archive(word__media__i_png=big)), ("2", "b.png", big)], "file_id string, name string, data binary")
    found = files.images(rows)
    assert sorted((r.file_id, r.nth, r.position, r.width) for r in found.collect()) == [("1", 1, "Image 1", None), ("2", 1, "Image", None)]
    text = "This is a sentence of some length that was read from an image, and it is kept."
    out = files.ocr(found, lambda b: text)
    assert out.count() == 2
    merged = files.merge_ocr(spark.createDataFrame([("1", "M"), ("3", "N")], "file_id string, markdown string"), out)
    assert {r.file_id: "Embedded Image Content" in r.markdown for r in merged.collect()} == {"1": True, "3": False}


def test_useful_ocr(spark):
    rows = spark.createDataFrame([("short",), ("ACME Global Corp",), ("One long sentence with enough words to be worth keeping here.",), ("a\nb\n" * 12,)], "t string")
    assert [r[0] for r in rows.select(files.useful_ocr(F.col("t"))).collect()] == [False, False, True, False]


def test_registry(spark):
    rows = spark.sql("select * from values ('a', true, 'x', timestamp'2024-01-01 00:00:00'), ('b', false, 'y', timestamp'2024-01-01 05:00:00'), ('c', true, 'z', timestamp'2024-01-01 05:00:00') t(file_id, success, markdown, uploaded_at)")
    now = "timestamp'2024-01-01 06:00:00'"
    assert {i: sinks.lookup(rows, i, now).first().status for i in "abcd"} == {"a": 410, "b": 409, "c": 200, "d": 404}
    assert sinks.evict(rows, now).count() == 2


def test_chunk_archives(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, chunk_idx int, chunk string")
    got = {r.doc_id: zipfile.ZipFile(io.BytesIO(r.archive)).namelist() for r in sinks.zip_chunks(rows).collect()}
    assert got == {1: ["1_chunk_001.md", "1_chunk_002.md"], 2: ["2_chunk_001.md"]}


def test_stream_drops_repeats(spark, tmp_path):
    spark.sql("select id as doc_id, 'same text' as text, timestamp'2024-01-01 00:00:00' as ts from range(3)").write.parquet(str(tmp_path / "in"))
    stream = ingest.distinct_texts(ingest.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string, ts timestamp"))
    run = stream.writeStream.format("memory").queryName("seen").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("seen").count() == 1
