"""Uploaded documents: the guard on name and size, and the text of Word and PDF files.

Folders are listed inside the tasks, so the driver never holds the files' names; the guard looks at path and length only,
so what it refuses is never read.  A Word file is a zip of XML parts and is opened inside the task; anything else is tried
as a PDF.
"""
from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts, staging
from .pdf import pdf_text

EXTENSIONS = ("pdf", "docx", "doc")
LARGEST = 10 * 1024 * 1024
#: Bytes that a Word file's text part may unpack to.
LARGEST_INSIDE = 256 << 20
#: Folders that written files are dealt over by their names.
FOLDERS = 4096
#: Files and bytes that a task reads, about.
_FILES, _BYTES = 2000, 64 << 20
#: Characters and rows after which a task passes on what it has.
_ENOUGH, _ROWS = 8 << 20, 10_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def taken(path: Column, size: Column) -> Column:
    """Whether an upload is let in: a known ending, in any case, and ten megabytes at most."""
    return F.coalesce(F.lower(path).rlike(rf"\.({'|'.join(EXTENSIONS)})$") & (size <= LARGEST), F.lit(False))


def word_text(content: bytes) -> str | None:
    """The paragraphs of a Word file with a blank line between them; None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts, parts.open("word/document.xml") as body:
            if parts.getinfo("word/document.xml").file_size > LARGEST_INSIDE:
                return None
            out, own = [], []
            for event, node in ElementTree.iterparse(body, ("start", "end")):
                if event == "start" and node.tag == f"{_W}p":
                    own = []
                elif event == "end":
                    if node.tag == f"{_W}t":
                        own.append(node.text or "")
                    elif node.tag == f"{_W}tab":
                        own.append("\t")
                    elif node.tag in (f"{_W}br", f"{_W}cr"):
                        own.append("\n")
                    elif node.tag == f"{_W}p":
                        out.append("".join(own))
                        node.clear()
            return "\n\n".join(out)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError):
        return None


def word_file(text: str) -> bytes:
    """A Word file with one paragraph a line; characters that XML cannot hold are left out."""
    from xml.sax.saxutils import escape

    def run(piece: str) -> str:
        return "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</w:t>' for x in piece.split("\t"))

    body = "".join(f"<w:p><w:r>{run(line)}</w:r></w:p>" for line in _UNFIT.sub("", text).split("\n"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as parts:
        parts.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def _root(path: str):
    """The file store of a path, and the path inside it as it is written: names of uploads are no URIs, and may hold % or spaces."""
    from .files import _files

    if "://" not in path:
        return _files(path)
    scheme, _, rest = path.partition("://")
    host, _, place = rest.partition("/")
    store, top = _files(f"{scheme}://{host}/")
    return store, f"{top.rstrip('/')}/{place}"


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of every upload below a folder, dealt over tasks by path.

    A level of folders is listed in one job and written down; the entries of one folder pass through one task."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = _root(path)
                inside = [x for x in store.get_file_info(fs.FileSelector(place)) if not _hidden(x.base_name)]
                for i in range(0, len(inside), _ROWS):
                    some = inside[i : i + _ROWS]
                    yield pa.record_batch([pa.array([f"{path.rstrip('/')}/{x.base_name}" for x in some], pa.string()), pa.array([x.size for x in some], pa.int64()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())], names=["path", "length", "is_folder"])

    at_once = spark.sparkContext.defaultParallelism
    level, found = spark.createDataFrame([(folder,)], "path string"), None
    while found is None or not level.isEmpty():
        seen = staging.written(level.repartition(at_once, "path").mapInArrow(entries, "path string, length long, is_folder boolean"))
        files = seen.filter("not is_folder").select("path", "length")
        level, found = seen.filter("is_folder").select("path"), files if found is None else found.unionByName(files)
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return found.repartition(max(at_once, n // _FILES, size // _BYTES), "path")


def extracted(files: DataFrame) -> DataFrame:
    """path, text (tidied), pages (of a PDF) and method of the uploads that are let in.  An unreadable file has no text; one
    without text, such as a scan, has an empty one.

    files: path, length and perhaps content; without it the tasks open what is let in."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
    held = [c for c in ("content",) if c in files.columns]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * len(kinds), kinds, strict=True)], names=["path", "raw", "pages", "method"])

    def text_of(name: str, content: bytes) -> tuple:
        if name.lower().endswith((".docx", ".doc")):
            return name, word_text(content), None, "word"
        try:
            return name, *pdf_text(content), "pdf"
        except (ValueError, TypeError, IndexError, OverflowError, RecursionError):  # whatever a broken file makes of its numbers and references
            return name, None, None, "pdf"

    def opened(name: str) -> bytes:
        store, place = _root(name)
        with store.open_input_stream(place, compression=None) as file:
            return file.read()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, name in enumerate(batch.column("path").to_pylist()):
                rows.append(text_of(name, batch.column("content")[i].as_py() if held else opened(name)))
                size += len(rows[-1][1] or "")
                if size > _ENOUGH:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    rows = files.filter(taken(F.col("path"), F.col("length"))).select("path", *held).mapInArrow(texts, "path string, raw string, pages int, method string")
    return rows.select("path", F.when(F.col("raw").isNotNull(), drafts.tidied(F.col("raw"))).alias("text"), "pages", "method")


def write_word_files(texts: DataFrame, folder: str) -> int:
    """name, text: one file each, written by the tasks into a folder that all share; how many.

    A file's folder in there goes by its name, so a task that runs again writes over its own files, and no folder holds many."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .files import _files

        store, path = _files(folder)
        made = set()
        store.create_dir(path, recursive=True)
        for batch in batches:
            sizes = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, own = word_file(text or ""), f"{path}/{zlib.crc32(name.encode()) % FOLDERS:03x}"
                if own not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                with store.open_output_stream(f"{own}/{name}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.record_batch([pa.array(sizes, pa.int64())], names=["size"])

    return texts.select("name", "text").mapInArrow(put, "size long").count()
