"""Uploaded files: validation, landing, and text extraction that fails one file and not the job."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, placeholder

#: Accepted media types and the extension that their files are stored under.
ACCEPTED = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/webp": ".webp",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Files of a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").load(path) if stream else spark.read.format("binaryFile").load(path)


def stored_extension(content_type: Column) -> Column:
    """The extension for a media type, null for one that isn't accepted."""
    return F.create_map(*[F.lit(x) for pair in ACCEPTED.items() for x in pair])[content_type]


def validate(uploads: DataFrame, max_mb: int = 20) -> DataFrame:
    """``uploads`` (content_type, length, ...) with stored_ext and error: null where the file is accepted.

    The type is looked at first; a file of exactly the limit passes.
    """
    checked = uploads.withColumn("stored_ext", stored_extension(F.col("content_type")))
    error = F.when(F.col("stored_ext").isNull(), "Unsupported file type").when(F.col("length") > max_mb * 1024 * 1024, f"File exceeds {max_mb}MB limit")
    return checked.withColumn("error", error)


def landing_path(folder: str, content: Column, ext: Column) -> Column:
    """Where a file is stored: named by its content, so that a repeated upload lands on the same file."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.sha2(content, 256), ext)


def land(uploads: DataFrame, folder: str) -> DataFrame:
    """Store accepted uploads (file_name, content_type, content) as rows below ``folder`` and give their pending documents.

    Rows are written by Spark's commit protocol: a failed job leaves no half-written file behind.
    """
    good = validate(uploads.withColumn("length", F.length("content"))).filter("error is null")
    rows = good.select(F.sha2(F.concat_ws("\0", "file_name", F.sha2("content", 256)), 256).alias("id"), "file_name", landing_path(folder, F.col("content"), F.col("stored_ext")).alias("file_path"), "content")
    rows.write.mode("append").parquet(folder)
    return rows.select("id", "file_name", "file_path", F.current_timestamp().alias("uploaded_at"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"))


def parse_pending(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The stored files (id, file_name, content) of pending documents."""
    return spark.read.schema("id string, file_name string, content binary").parquet(*paths)


def docx_text(content: bytes) -> str:
    """Paragraphs of a document's body that aren't blank, a line each; tables, headers and notes are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for paragraph in body.findall(f"{_W}p") if body is not None else []:
        marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        line = "".join(marks[e.tag](e) for run in paragraph.iter(f"{_W}r") for e in run if e.tag in marks)
        if line.strip():
            lines.append(line)
    return "\n".join(lines)


def docx_bytes(paragraphs: list[str]) -> bytes:
    """The smallest Word document with these paragraphs."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        file.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf_bytes(pages: list[str]) -> bytes:
    """The bare streams of a PDF that shows one line a page, in Windows Latin-1."""
    parts = [b"%PDF-1.4\n"]
    for page in pages:
        shown = re.sub(rb"([\\()])", rb"\\\1", page.encode("cp1252", "replace"))
        data = zlib.compress(b"BT /F1 12 Tf (" + shown + b") Tj ET")
        parts.append(b"<</Length %d /Filter /FlateDecode>>\nstream\n" % len(data) + data + b"\nendstream\n")
    return b"".join(parts)


def pdf_text(content: bytes) -> str:
    """Text of a PDF's pages, a line break between; by PyMuPDF where it is installed, else of plain text operators only."""
    try:
        import fitz
    except ImportError:
        return _plain_pdf_text(content)
    with fitz.open(stream=content, filetype="pdf") as pages:
        return "\n".join(page.get_text() for page in pages)


def _plain_pdf_text(content: bytes) -> str:
    """Strings shown by Tj and TJ in unencoded or deflated streams with standard encodings; an error for anything else."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    if b"/Encrypt" in content:
        raise ValueError("encrypted PDF")
    pages = []
    for head, data in re.findall(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        if b"/FlateDecode" in head:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" not in data:
            continue
        shown = re.findall(rb"\((?:\\.|[^\\()])*\)(?=[^\[\]]*?(?:Tj|TJ|'|\"))|(?:T\*|Td|TD|ET)", data, re.S)
        text = "".join("\n" if not s.startswith(b"(") else _pdf_string(s[1:-1]) for s in shown)
        pages.append(re.sub("\n+", "\n", text).strip("\n"))
    if not pages:
        raise ValueError("no readable text in this PDF")
    return "\n".join(pages)


def _pdf_string(raw: bytes) -> str:
    plain = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
    one = lambda m: chr(int(m[1], 8) & 255).encode("latin1") if m[1].isdigit() else plain.get(m[1], m[1].decode("latin1")).encode("latin1")
    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S).decode("cp1252", "replace")


PARSERS: dict[str, Callable[[bytes], str]] = {".pdf": pdf_text, ".docx": docx_text}


def parse(files: DataFrame, *, error_chars: int = 500) -> DataFrame:
    """``files`` (file_name, content, ...) without content, with text and error.

    The extension of the file *name* chooses the parser; every other file is a placeholder.  A file
    that can't be parsed gets the error's head and no text, and the job goes on.
    """
    rest = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest) + ", text string, error string"
    tagged = files.withColumn("parser", extension(F.col("file_name")))
    plain = tagged.filter(~F.coalesce(F.col("parser").isin(*PARSERS), F.lit(False))).select(*rest, placeholder(F.col("file_name")).alias("text"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, content in zip(batch.column("parser").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    texts.append(PARSERS[kind](content or b""))
                    errors.append(None)
                except Exception as error:  # one file's failure is data
                    texts.append(None)
                    errors.append((str(error) or type(error).__name__)[:error_chars])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*rest, "text", "error"])

    parsed = tagged.filter(F.col("parser").isin(*PARSERS)).select(*rest, "content", "parser").mapInArrow(run, schema)
    return plain.unionByName(parsed)
