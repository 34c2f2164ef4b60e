"""Word documents as a data source: files are planned into partitions by size and their XML is read as a stream."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_P, _T = f"{{{_NS}}}p", f"{{{_NS}}}t"
#: Bytes and files that a partition reads, and paragraphs that a batch of rows holds.
PARTITION_BYTES, PARTITION_FILES, BATCH = 32 << 20, 512, 2000
#: Paragraphs of a file that a task keeps rather than read it twice.
HELD = 20_000
SCHEMA = "path string, i int, text string"
#: What XML can't hold.
_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def paragraphs(f: BinaryIO) -> Iterator[tuple[int, str]]:
    """Number (from 0, over all paragraphs in the order they begin) and text of those with text. Elements are let go as
    they end, so a document of any length takes no more memory than its longest paragraph."""
    with zipfile.ZipFile(f) as z, z.open("word/document.xml") as xml:
        above: list[ElementTree.Element] = []
        open_: list[tuple[int, list[str]]] = []
        n = 0
        for event, e in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                above.append(e)
                if e.tag == _P:
                    open_.append((n, []))
                    n += 1
                continue
            if e.tag == _T and e.text:
                for _, parts in open_:
                    parts.append(e.text)
            elif e.tag == _P:
                i, parts = open_.pop()
                if text := "".join(parts).strip():
                    yield i, text
            above.pop()
            if above:
                above[-1].remove(e)


_BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, ValueError, OSError)


def whole_rows(path: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
    """Batches of a file's paragraphs; of one that can't be read to its end, none. A long one is read to its end before its
    paragraphs are handed on in a second reading."""
    try:
        all_ = paragraphs(f)
        rows = list(islice(all_, HELD))
        more = len(rows) == HELD
        for _ in all_:
            pass
    except _BROKEN:
        return
    if more:
        f.seek(0)
    rest = paragraphs(f) if more else iter(rows)
    while part := list(islice(rest, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.string())], ["path", "i", "text"])


def can_open(path: str) -> bool:
    """Whether Python's tasks can open the path's store themselves."""
    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")


@dataclass
class Files(InputPartition):
    names: list[str]


class DocxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"].rstrip("/"), options.get("glob", "*.docx")

    def partitions(self) -> list[InputPartition]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and fnmatch(f.base_name, self.glob) and not f.base_name.startswith(("~$", "_", ".")))
        out, size = [], 0
        for name, n in files:
            if not out or size + n > PARTITION_BYTES or len(out[-1].names) >= PARTITION_FILES:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        scheme = re.match("(?:[a-z0-9]+:/*(?=/))?", self.path)[0]
        for name in partition.names:
            with store.open_input_file(name) as f:
                yield from whole_rows(f"{scheme}{name}", f)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def document_bytes(text: str | None) -> bytes:
    """A document with a paragraph for each line; characters that XML can't hold are left out."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_BAD.sub("", line))}</w:t></w:r></w:p>' for line in (text or "").split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_NS}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


class DocxWriter(DataSourceArrowWriter):
    """A file for each row (name, text), under a temporary name until the job is committed."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        names = []
        for batch in batches:
            for r in batch.to_pylist():
                names.append(f"_{self.job}-{uuid.uuid4().hex}-{quote(r['name'], safe='')}.docx")
                with store.open_output_stream(f"{path}/{names[-1]}") as f:
                    f.write(document_bytes(r["text"]))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        for m in messages:
            for n in m.names if m else []:
                store.move(f"{path}/{n}", f"{path}/{n.split('-', 2)[2]}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = _opened(self.path)
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                store.delete_file(f.path)


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocxReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DocxWriter(self.options)


def read_paragraphs(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """path, i, text of the paragraphs with text in the documents below path."""
    spark.dataSource.register(DocxSource)
    return spark.read.format("docx").option("path", path).option("glob", glob).load()


def write_documents(df: DataFrame, path: str) -> None:
    """df(name, text) as documents: a file <name>.docx for each row (characters that a file name can't hold are
    percent-encoded), a paragraph for each line. Names are unique; of equal ones one file is left."""
    df.sparkSession.dataSource.register(DocxSource)
    df.select("name", "text").write.format("docx").mode("append").option("path", path).save()


def document_name(path: str) -> str:
    return unquote(path.rpartition("/")[2].removesuffix(".docx"))
