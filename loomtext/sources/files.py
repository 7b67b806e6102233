"""File sources: uploads, archives, HTML, embedded images, and the rules for text found in images."""

from __future__ import annotations

import base64
import hashlib
import html
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

MAX_UPLOAD = 150 << 20
MAX_ARCHIVE = 500 << 20
MAX_MEMBERS = 1000
_TEXT = ("txt", "md", "rst", "csv", "json", "xml")


def supported(name: Column) -> Column:
    """Whether a file's extension is on the list."""
    return T.suffix(name).isin(*P.EXTENSIONS)


def uploads(spark: SparkSession, path: str, limit: int = MAX_UPLOAD) -> DataFrame:
    """(file_id, name, size, uploaded_at, data, supported, error): too large files have an error and no data.

    Spark's file source lists no empty files.
    """
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    error = F.when(F.col("length") > limit, "file too large")
    return rows.select(F.md5("path").alias("file_id"), name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at"), F.when(error.isNull(), F.col("content")).alias("data"), supported(name).alias("supported"), error.alias("error"))


def members(files: DataFrame, most_bytes: int = MAX_ARCHIVE, most_members: int = MAX_MEMBERS) -> DataFrame:
    """Files of ZIP archives: (file_id, member, data, error), by name. Folders, system and hidden files and those of
    other kinds are left out; an archive or member that cannot be read is a row with an error."""

    def wanted(i: zipfile.ZipInfo) -> bool:
        base = i.filename.rsplit("/", 1)[-1]
        ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
        return not i.is_dir() and "__MACOSX" not in i.filename and not base.startswith(".") and ext in P.EXTENSIONS and ext != "zip"

    def rows(file_id: str, data: bytes) -> Iterator[tuple]:
        if len(data) > most_bytes:
            yield file_id, None, None, "archive too large"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                found = sorted((i for i in z.infolist() if wanted(i)), key=lambda i: i.filename)
                if not found or len(found) > most_members:
                    yield file_id, None, None, "too many files" if found else "no supported files"
                    return
                for i in found:
                    try:
                        yield file_id, i.filename, z.read(i), None
                    except Exception as e:
                        yield file_id, i.filename, None, str(e)
        except zipfile.BadZipFile as e:
            yield file_id, None, None, str(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows(a, b or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), pa.array([row[1]], pa.string()), pa.array([row[2]], pa.binary()), pa.array([row[3]], pa.string())], ["file_id", "member", "data", "error"])

    return files.select("file_id", "data").mapInArrow(work, "file_id string, member string, data binary, error string")


class _Markdown(HTMLParser):
    """HTML to Markdown: headings, paragraphs, lists, links, emphasis, code, tables, images."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str] = []
        self.lists: list[list] = []
        self.cells: list[str] | None = None
        self.header = False
        self.pre = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head", "noscript", "template"):
            self.hidden += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "section", "header", "footer", "nav", "main", "blockquote"):
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            self.lists = self.lists or [["ul", 0]]
            self.lists[-1][1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "))
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.header = True
            self.out.append("\n\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch(r"h[1-6]|p|div|article|section|header|footer|nav|main|blockquote|table", tag):
            self.out.append("\n\n")
        elif tag in ("ul", "ol"):
            self.lists = self.lists[:-1]
            self.out.append("\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "tr" and self.cells is not None:
            row, self.cells = self.cells, None
            if row:
                self.out.append("| " + " | ".join(c.strip() for c in row) + " |\n")
                if self.header:
                    self.out.append("| " + " | ".join("---" for _ in row) + " |\n")
                    self.header = False

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        data = data if self.pre else re.sub(r"\s+", " ", data)
        if self.cells:
            self.cells[-1] += data
        else:
            self.out.append(data)


def html_to_markdown(page: str) -> str:
    """Markdown of one page; broken HTML gives what could be read."""
    parser = _Markdown()
    parser.feed(page or "")
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out)) if "```" not in "".join(parser.out) else "".join(parser.out)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _runs(xml: str) -> str:
    return html.unescape("".join(re.findall(r"<(?:w:t|a:t|t)(?: [^>]*)?>([^<]*)<", xml))).strip()


def _pipe_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    full = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |" for r in full]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines and width else ""


def _blocks(xml: str) -> str:
    """Paragraphs, headings and tables of a document or slide, in order."""
    out = []
    for m in re.finditer(r"<(w:tbl|a:tbl)[ >].*?</\1>|<(w:p|a:p)[ >].*?</\2>", xml, re.S):
        if m[1]:
            rows = re.findall(r"<(?:w:tr|a:tr)[ >].*?</(?:w:tr|a:tr)>", m[0], re.S)
            out.append(_pipe_table([[_runs(c) for c in re.findall(r"<(?:w:tc|a:tc)[ >].*?</(?:w:tc|a:tc)>", r, re.S)] for r in rows]))
        else:
            style = re.search(r'<w:pStyle w:val="(?:Heading|heading )([1-6])"', m[0])
            text = _runs(m[0])
            out.append("#" * int(style[1]) + " " + text if style and text else text)
    return "\n\n".join(x for x in out if x)


def _sheets(z: zipfile.ZipFile) -> str:
    """The cells of each sheet as a table, shared strings in their places."""
    names = z.namelist()
    shared = [_runs(x) for x in re.findall(r"<si[ >].*?</si>", z.read("xl/sharedStrings.xml").decode("utf-8", "replace"), re.S)] if "xl/sharedStrings.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for k, n in enumerate(sheets, 1):
        rows = []
        for row in re.findall(r"<row[ >].*?</row>", z.read(n).decode("utf-8", "replace"), re.S):
            cells: list[str] = []
            for ref, attrs, body in re.findall(r'<c r="([A-Z]+)\d+"([^>]*)>(.*?)</c>', row, re.S):
                at = 0
                for letter in ref:
                    at = at * 26 + ord(letter) - 64
                value = re.search(r"<v>([^<]*)</v>", body)
                text = _runs(body) if 't="inlineStr"' in attrs else html.unescape(value[1]) if value else ""
                cells += [""] * (at - len(cells))
                cells[at - 1] = shared[int(text)] if 't="s"' in attrs and text.isdigit() and int(text) < len(shared) else text
            rows.append(cells)
        out.append(f"## Sheet {k}\n\n" + _pipe_table(rows))
    return "\n\n".join(out)


def to_text(name: str, data: bytes) -> str:
    """Markdown of a file of the text family or an office archive; other kinds raise."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext in ("html", "htm"):
        return html_to_markdown(data.decode("utf-8", "replace"))
    if ext in _TEXT:
        return data.decode("utf-8", "replace")
    if ext in ("docx", "pptx", "epub", "xlsx"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if ext == "epub":
                return "\n\n".join(html_to_markdown(z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith(("html", "htm")))
            if ext == "xlsx":
                return _sheets(z)
            wanted = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}[ext]
            names = sorted((n for n in z.namelist() if re.fullmatch(wanted, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
            return "\n\n".join(_blocks(z.read(n).decode("utf-8", "replace")) for n in names)
    raise ValueError(f"no extractor for .{ext}")


def convert(files: DataFrame, name: str = "name", extract: Callable[[str, bytes], str] = to_text, fallback: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(file_id, name, markdown, extractor, success, error): the extractor, and if it fails the fallback."""

    def one(n: str, data: bytes | None) -> tuple:
        error = None
        for tag, f in (("general", extract), ("general->fallback", fallback)):
            if f is not None and data is not None:
                try:
                    return f(n, data), tag, True, None
                except Exception as e:
                    error = error or str(e)
        return "", "general", False, error or "no data"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(n or "", d) for n, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([d[k] for d in done], t) for k, t in enumerate(kinds))], ["file_id", "name", "markdown", "extractor", "success", "error"])

    return files.select("file_id", F.col(name).alias("name"), "data").mapInArrow(work, "file_id string, name string, markdown string, extractor string, success boolean, error string")


def pages_to_markdown(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, content): Markdown of HTML pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_to_markdown(x or "") for x in batch.column(1).to_pylist()], pa.string())], [key, "content"])

    return pages.select(F.col(key).cast("long").alias(key), page).mapInArrow(work, f"{key} long, content string")


#: Least bytes, width and height of an image that is looked at.
LEAST_BYTES = 500
LEAST_SIDE = 60


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, GIF, BMP or JPEG image; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def to_png(data: bytes) -> bytes:
    """The image as RGB PNG where an imaging library is there, else as it is."""
    try:
        from PIL import Image
    except ImportError:
        return data
    out = io.BytesIO()
    Image.open(io.BytesIO(data)).convert("RGB").save(out, "PNG")
    return out.getvalue()


def png(width: int, height: int, rows: bytes, channels: int = 3) -> bytes:
    """A PNG file of raw 8-bit grey or RGB rows."""
    step = width * channels
    raw = b"".join(b"\0" + rows[k * step : (k + 1) * step] for k in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pdf_images(data: bytes) -> list[tuple[str, str, bytes]]:
    """(label, name, image) of the JPEG and plain 8-bit images of a PDF, page by page.

    Only objects that stand by themselves are read, not those inside of compressed object streams.
    """
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}

    def follow(body: bytes, key: bytes) -> bytes:
        """The value of a key: the object it refers to, else what follows it."""
        found = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
        if found:
            return objects.get(int(found[1]), b"")
        at = re.search(rb"/" + key + rb"\b", body)
        return body[at.end() :] if at else b""

    def image(body: bytes) -> bytes | None:
        head, _, rest = body.partition(b"stream")
        raw = rest.lstrip(b"\r\n").rpartition(b"endstream")[0]
        number = lambda key: int(m[1]) if (m := re.search(rb"/" + key + rb"\s+(\d+)", head)) else 0
        if b"/DCTDecode" in head:
            return raw
        if b"/FlateDecode" in head and number(b"BitsPerComponent") == 8 and b"/Predictor" not in head:
            rows, width, height = zlib.decompress(raw), number(b"Width"), number(b"Height")
            channels = len(rows) // max(1, width * height)
            return png(width, height, rows, channels) if channels in (1, 3) else None
        return None

    out = []
    pages = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", body)]
    for n, page in enumerate(pages, 1):
        named = follow(follow(page, b"Resources") or page, b"XObject")
        for name, ref in re.findall(rb"/([A-Za-z0-9_.]+)\s+(\d+)\s+\d+\s+R", named.partition(b">>")[0]):
            body = objects.get(int(ref), b"")
            if re.search(rb"/Subtype\s*/Image", body) and (found := image(body)) is not None:
                out.append((f"Page {n}", name.decode(), found))
    return out


def _office_images(ext: str, z: zipfile.ZipFile) -> list[tuple[str, str, bytes]]:
    """Images of an office archive by the paragraph or slide that shows them; those that none shows come last."""
    names = set(z.namelist())
    unit = {"docx": ("Paragraph", r"word/document\.xml", r"<w:p[ >].*?</w:p>"), "pptx": ("Slide", r"ppt/slides/slide(\d+)\.xml", r"<p:sld[ >].*</p:sld>")}.get(ext)
    out = []
    if unit:
        label, part, block = unit
        found = sorted((n for n in names if re.fullmatch(part, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        for k, n in enumerate(found, 1):
            folder, _, base = n.rpartition("/")
            rels = f"{folder}/_rels/{base}.rels"
            targets = dict(re.findall(r'Id="([^"]+)"[^>]*?Target="([^"]+)"', z.read(rels).decode("utf-8", "replace"))) if rels in names else {}
            body = re.sub(r"<w:tbl[ >].*?</w:tbl>", "", z.read(n).decode("utf-8", "replace"), flags=re.S)
            for i, text in enumerate(re.findall(block, body, re.S), 1):
                for ref in re.findall(r'r:embed="([^"]+)"', text):
                    path = posixpath.normpath(posixpath.join(folder, targets.get(ref, ""))).lstrip("/")
                    if path in names and path.rsplit(".", 1)[-1].lower() in P.IMAGE_EXTENSIONS:
                        out.append((f"{label} {i if ext == 'docx' else k}", path, z.read(path)))
    shown = {x[1] for x in out}
    media = sorted(n for n in names if n.rsplit(".", 1)[-1].lower() in P.IMAGE_EXTENSIONS and n not in shown)
    out += [(f"Image {k}", n, z.read(n)) for k, n in enumerate(media, len(out) + 1)]
    return [(label, n.rsplit("/", 1)[-1], data) for label, n, data in out]


def images_of(name: str, data: bytes) -> list[tuple[str, str, bytes]]:
    """(position, source, bytes) of the images in a file: PDF pages, office archives, data URIs of HTML, images themselves."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    out: list[tuple[str, str, bytes]] = []
    if ext == "pdf":
        out = pdf_images(data)
    elif ext in ("docx", "pptx", "xlsx", "epub"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out = _office_images(ext, z)
    elif ext in ("html", "htm"):
        for k, m in enumerate(re.finditer(r"""<img[^>]+src\s*=\s*["']?data:image/([a-z]+)(;base64)?,([^"'\s>]+)""", data.decode("utf-8", "replace"), re.I), 1):
            out.append((f"Image {k}", f"image.{m[1]}", base64.b64decode(m[3]) if m[2] else unquote_to_bytes(m[3])))
    elif ext in P.IMAGE_EXTENSIONS:
        out = [("Image", name, data)]
    large = lambda size: size is None or min(size) >= LEAST_SIDE
    return [x for x in out if len(x[2]) >= LEAST_BYTES and large(image_size(x[2]))]


_IMAGE = "file_id string, nth int, position string, source string, width int, height int, sha256 string, image binary"


def images(files: DataFrame, name: str = "name") -> DataFrame:
    """(file_id, nth, position, source, width, height, sha256, image) of the images in files; unreadable files have none.

    nth counts a file's images from 1; width and height are null where the header does not tell them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, n, d in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    found = [(label, source, to_png(data)) for label, source, data in images_of(n or "", d or b"")]
                except Exception:
                    found = []
                if found:
                    sizes = [image_size(x[2]) or (None, None) for x in found]
                    columns = [
                        pa.array([f] * len(found)), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([x[0] for x in found]), pa.array([x[1] for x in found]),
                        pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32()),
                        pa.array([hashlib.sha256(x[2]).hexdigest() for x in found]), pa.array([x[2] for x in found], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _IMAGE.split(", ")])

    return files.select("file_id", name, "data").mapInArrow(work, _IMAGE)


def needs_ocr(name: Column, text: Column) -> Column:
    """An image file, or hardly any text."""
    return T.suffix(name).isin(*P.IMAGE_EXTENSIONS) | (F.length(T.strip(F.coalesce(text, F.lit("")))) < 80)


def useful_ocr(text: Column) -> Column:
    """Whether text found in an image is worth keeping: long enough, no logo, no noise, no list of coordinates."""
    t = T.strip(F.coalesce(text, F.lit("")))
    w = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    titled = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    logo = (F.size(w) < 5) & (F.length(t) < 60) & (titled > 0.5 * F.size(w)) & ~t.rlike(r"[.,;:!?]")
    rows = F.filter(T.lines(t), lambda x: T.strip(x) != "")
    sparse = (F.size(rows) > 15) & (F.size(w) / F.greatest(F.size(rows), F.lit(1)) < 3)
    often = F.exists(F.array_distinct(F.filter(w, lambda x: F.length(x) > 2)), lambda x: F.size(F.filter(w, lambda y: y == x)) > 4)
    coordinates = F.regexp_count(t, F.lit(r"\b\d{1,3}\.\d{3,}\b")) > 3
    return (F.length(t) >= 40) & ~logo & ~sparse & ~often & ~coordinates


def useful_size(width: Column, height: Column) -> Column:
    return (width * height >= 50_000) & (width / height).between(0.15, 8)


def _read_all(rows: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """rows (sha256, image) -> (sha256, text); an image that cannot be read has no text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for b in batch.column(1).to_pylist():
                try:
                    texts.append(read(b))
                except Exception:
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["sha256", "text"])

    return rows.mapInArrow(work, "sha256 string, text string")


def ocr(found: DataFrame, read: Callable[[bytes], str], smart: bool = True) -> DataFrame:
    """(file_id, nth, position, text): read is called once for each distinct image; smart leaves out images and texts of no use."""
    if smart:
        found = found.filter(F.coalesce(useful_size(F.col("width"), F.col("height")), F.lit(True)))
    once = _read_all(found.select("sha256", "image").dropDuplicates(["sha256"]), read)
    out = found.select("file_id", "nth", "position", "sha256").join(once, "sha256").select("file_id", "nth", "position", "text")
    return out.filter(useful_ocr(F.col("text"))) if smart else out.filter(T.strip(F.col("text")) != "")


def merge_ocr(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts (file_id, markdown) with the text of images (file_id, nth, position, text) at the end, in order of nth."""
    block = F.format_string("### Extracted Image Text (%s)\n\n```\n%s\n```", "position", "text")
    added = found.withColumn("block", block).groupBy("file_id").agg(F.expr("listagg(block, '\n\n') within group (order by nth, position)").alias("blocks"))
    text = F.when(F.col("blocks").isNull(), F.col("markdown")).otherwise(F.concat("markdown", F.lit("\n\n---\n\n## Embedded Image Content\n\n"), "blocks"))
    return texts.join(added, "file_id", "left").select("file_id", text.alias("markdown"))


def whole_ocr(files: DataFrame, read: Callable[[bytes], str], name: str = "name") -> DataFrame:
    """(file_id, markdown, warning): a PDF's pages, each under a mark with its number, or the image itself.

    The pages of a scan are its images; other kinds of files have a warning and no text.
    """
    kind = T.suffix(F.col(name))
    is_image, is_pdf = kind.isin(*P.IMAGE_EXTENSIONS), kind == "pdf"
    found = images(files.filter(is_image | is_pdf).withColumnRenamed(name, "name"))
    texts = found.join(_read_all(found.select("sha256", "image").dropDuplicates(["sha256"]), read), "sha256")
    marked = F.when(F.col("position").startswith("Page "), F.format_string("<!-- %s -->\n%s", "position", "text")).otherwise(F.col("text"))
    pages = texts.withColumn("part", marked).groupBy("file_id").agg(F.expr("listagg(part, '\n\n') within group (order by nth)").alias("markdown"))
    warning = F.when(~(is_image | is_pdf), F.concat(F.lit("no optical recognition for ."), kind)).when(F.col("markdown").isNull(), "no image to read")
    return files.join(pages, "file_id", "left").select("file_id", F.coalesce("markdown", F.lit("")).alias("markdown"), warning.alias("warning"))


def route(document_type: Column, override: Column) -> Column:
    """The extractor's name: an override, else by document type."""
    return F.coalesce(F.when(override.isin("general", "research"), override), F.when(document_type == "research_paper", "research").otherwise("general"))
