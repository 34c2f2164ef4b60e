"""The "warc" data source: reads and writes WARC/1.1 archives in any store that pyarrow.fs opens.

Reading plans one partition for each file. Equality and IN predicates on record_type, page_id and the
header-backed columns are pushed down; each record's headers are parsed first and its block is skipped by
Content-Length if a predicate rejects it or the schema asks for no payload. In gzip-compressed archives
(*.gz) whose members state their length in an "sl" extra field, as this writer's do, a member's first
kilobytes are read and inflated and the rest is seeked over unless its payload is wanted; other archives
are read as a stream. Writing gives each task files of its own under temporary names; the driver's commit
renames them and deletes those of failed attempts, so retried and speculative tasks leave nothing behind."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Of these a record's headers alone tell the value.
HEAD_COLUMNS = ("page_id", "url", "record_type", "payload_digest", "refers_to")
FILE_BYTES = 256 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, nth: int, url: str | None, record_type: str, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}:{nth}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}",
    ]
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:x-page:{refers_to}:0>")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own for one record, with its compressed and plain length in the extra field."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def sized(store: fs.FileSystem, path: str) -> bool:
    """Whether the archive's first member has the extra field."""
    with store.open_input_stream(path, compression=None) as f:
        head = f.read(14)
    return head[:4] == b"\x1f\x8b\x08\x04" and head[10:14] == b"\x0c\x00sl"


class _Members:
    """readline, read and relative seek inside the records of an archive written by member()."""

    def __init__(self, f: "_Lines"):
        self.f, self.plain, self.z, self.at, self.left = f, b"", None, 0, 0

    def readline(self) -> bytes:
        while (end := self.plain.find(b"\n", self.at)) < 0 and self._more(4096):
            pass
        end = len(self.plain) - 1 if end < 0 else end
        line, self.at = self.plain[self.at : end + 1], end + 1
        return line if line or not self._next() else self.readline()

    def read(self, n: int) -> bytes:
        while len(self.plain) - self.at < n and self._more(max(4096, n)):
            pass
        out, self.at = self.plain[self.at : self.at + n], self.at + n
        return out

    def seek(self, _n: int, _whence: int) -> None:
        """The block and what follows it are the rest of the member, which needn't be read."""
        self.f.seek(self.left, 1)
        self.z, self.plain, self.at, self.left = None, b"", 0, 0

    def _next(self) -> bool:
        self.f.seek(self.left, 1)
        head = self.f.read(24)
        if len(head) < 24:
            return False
        self.z, self.left = zlib.decompressobj(-15), struct.unpack_from("<I", head, 16)[0] - 24
        self.plain, self.at = b"", 0
        return True

    def _more(self, n: int) -> bool:
        """Inflates up to n bytes more; compressed bytes are read as they are needed."""
        if self.z is None or self.z.eof:
            return False
        data = self.z.unconsumed_tail
        if not data:
            data = self.f.read(min(self.left - 8, max(2048, n)))
            self.left -= len(data)
        got = self.z.decompress(data, n)
        self.plain += got
        return bool(got) or (bool(data) and not self.z.eof)


def headers(f: BinaryIO) -> dict[str, str] | None:
    """The named fields of the next record (names in lower case), with the position before its block; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def page_of(field: str | None) -> int | None:
    m = re.match(r"<urn:x-page:(-?\d+):", field or "")
    return int(m[1]) if m else None


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names, self.wanted = options["path"], schema.names, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEAD_COLUMNS:
                had = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if had is None else had & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        names = sorted(f.path for f in files if f.is_file and re.search(r"\.warc(\.gz)?$", f.path))
        return [WarcFile(scheme + n) for n in names]

    def read(self, partition: WarcFile | None) -> Iterator[tuple]:
        if partition is None:  # a folder without archives
            return
        store, path = opened(partition.path)
        payloads = "payload" in self.names
        packed = path.endswith(".gz")
        with store.open_input_file(path) as raw:
            f = (_Members(_Lines(raw)) if sized(store, path) else gzip.GzipFile(fileobj=raw)) if packed else _Lines(raw)
            while (h := headers(f)) is not None:
                size = int(h.get("content-length", 0))
                digest = h.get("warc-payload-digest", "")
                row = {
                    "page_id": page_of(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"),
                    "payload_digest": digest.rpartition(":")[2] or None, "refers_to": page_of(h.get("warc-refers-to")),
                }
                if any(row[k] not in v for k, v in self.wanted.items()):
                    f.seek(size, 1)
                    continue
                if payloads and row["record_type"] != "revisit":
                    block = f.read(size)
                    at = block.find(b"\r\n\r\n") + 4 if h.get("content-type", "").startswith("application/http") else 0
                    row["payload"] = block[at:]
                    row["payload_bytes"], row["payload_digest"] = size - at, digest_of(row["payload"])
                else:
                    f.seek(size, 1)
                    row["payload_bytes"] = int(h["warc-payload-length"]) if "warc-payload-length" in h else None
                yield tuple(row.get(n) for n in self.names)


class _Lines:
    """readline, read and relative seek over a random-access file, through a buffer that a long skip jumps over."""

    def __init__(self, f, size: int = 1 << 18):
        self.f, self.size, self.buffer, self.at = f, size, b"", 0

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            more = self.f.read(self.size)
            self.buffer, self.at = self.buffer[self.at :] + more, 0
            if not more:
                end = len(self.buffer) - 1
                break
        line, self.at = self.buffer[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and (more := self.f.read(max(self.size, n))):
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        got, self.at = self.buffer[self.at : self.at + n], min(len(self.buffer), self.at + n)
        return got

    def seek(self, n: int, _whence: int) -> None:
        left = len(self.buffer) - self.at
        if n > left:
            self.f.seek(self.f.tell() + n - left)
        self.at += min(n, left)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, nth, url, record_type, payload_bytes, digest (hex SHA-1), refers_to and payload columns."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{path}/{names[-1]}.writing"), 0
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    data = record_bytes(r["page_id"], r["nth"], r["url"], r["record_type"], r["payload"] or b"", r["payload_bytes"], digest, r["refers_to"])
                    data = member(data)
                    out.write(data)
                    size += len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        for m in messages:
            for n in m.names if m else []:
                store.move(f"{path}/{n}.writing", f"{path}/{n}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes what is left of this job under temporary names, failed attempts' files included."""
        store, path = opened(self.path)
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name.endswith(".writing"):
                store.delete_file(f.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)
