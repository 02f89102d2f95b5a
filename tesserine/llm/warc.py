"""WARC archives as Zstandard files with an embedded dictionary.

A task gathers records until they hold ``file_bytes``, trains a dictionary on all records of that
file, and writes: a skippable frame (magic 0x184D2A5D) with the dictionary, itself
compressed; then a frame of its own for every record, the ``warcinfo`` first.  Any record
can be read alone from its offset, with the dictionary at the head of its file.

The sink is a Spark data source.  Every attempt of a task writes files of its own names; the
commit writes a manifest of those that count, so a lost executor or a repeated task leaves
nothing behind that a reader would take for data.  Files go through ``pyarrow.fs``: any
shared store that it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "tesserine_warc"
DICTIONARY_BYTES, FILE_BYTES, LEVEL = 112_640, 64 << 20, 3
MAGIC = 0x184D2A5D
SCHEMA = "file string, offset long, length long, page_id long, url string, record_id string, digest string, intact boolean, html string"
_TYPES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("digest", pa.string()), ("intact", pa.bool_()), ("html", pa.string())])
_URN = "urn:page:"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a URI names and the path in it; ``s3a`` and ``s3n`` are Hadoop's names of S3."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str | None, page: int | None, payload: bytes, record_id: str, date: str, content_type: str) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri}")
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    head += [f"WARC-Payload-Digest: {digest(payload)}", f"Content-Type: {content_type}", f"Content-Length: {len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block doesn't have the length that it states")
    return fields, rest[:n]


def escape(url: str) -> str:
    """White space and control characters percent-encoded, so that a URL can't break its header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from all the records, of at most a quarter of their size; None where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 4)), records, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], dictionary: int = DICTIONARY_BYTES, level: int = LEVEL) -> Iterator[bytes]:
    """The frames of a file: the dictionary's, if there is one, then one for each record."""
    d = train(records, dictionary)
    if d:
        body = zstandard.ZstdCompressor(level=19).compress(d.as_bytes())
        yield struct.pack("<II", MAGIC, len(body)) + body
    packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(level=level, write_checksum=True)
    for r in records:
        yield packer.compress(r)


def frames(data: bytes, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every record of a file."""
    at, d = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        body = data[8 : 8 + size]
        d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == b"\x28\xb5\x2f\xfd" else body)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one, parts, end = reader.decompressobj(), [], at
        while not one.eof:
            piece = view[end : end + step]
            if not len(piece):
                raise ValueError("the file ends within a record")
            parts.append(one.decompress(piece))
            end += len(piece)
        end -= len(one.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema) -> None:
        self.options = options
        self.at = [f.name for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.options["path"])
        fs.create_dir(root, recursive=True)
        limit, job, date = int(self.options.get("filebytes", FILE_BYTES)), self.options["job"], self.options["date"]
        part = TaskContext.get().partitionId()
        files: list[str] = []
        held: list[bytes] = []
        count, size = 0, 0

        def out() -> None:
            name = f"{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.warc.zst"
            info = record("warcinfo", None, None, b"format: WARC File Format 1.1\r\n", str(uuid.uuid5(uuid.UUID(job), name)), date, "application/warc-fields")
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                for frame in archive([info, *held], int(self.options.get("dictionarybytes", DICTIONARY_BYTES))):
                    f.write(frame)
            files.append(name)

        for b in iterator:
            for page, url, html in zip(*(b.column(self.at.index(c)).to_pylist() for c in ("page_id", "url", "html"))):
                uri = escape(url) if url else f"{_URN}{'' if page is None else page}"
                held.append(record("resource", uri, page, html.encode(), str(uuid.uuid5(uuid.UUID(job), f"{part}/{count}")), date, "text/html"))
                count += 1
                size += len(held[-1])
                if size >= limit:
                    out()
                    held.clear()
                    size = 0
        if held:
            out()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.options["path"])
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{self.options['job']}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.options["path"])
        for name in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{root}/{name}")


@dataclass
class File(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[File]:
        fs, root = _store(self.options["path"])
        names: list[str] = []
        for x in fs.get_file_info(pyarrow.fs.FileSelector(root)):
            if x.base_name.startswith("manifest-"):
                with fs.open_input_stream(x.path) as f:
                    names += json.loads(f.read())
        return [File(n) for n in sorted(names)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _store(self.options["path"])
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None) as f:
            data = f.read()
        rows, size = [], 0
        for offset, length, raw in frames(data):
            fields, payload = parse(raw)
            if fields["WARC-Type"] != "resource":
                continue
            page = fields.get("WARC-Page-ID")
            uri = fields["WARC-Target-URI"]
            rows.append((partition.name, offset, length, None if page is None else int(page), None if uri.startswith(_URN) else uri, fields["WARC-Record-ID"], fields["WARC-Payload-Digest"], digest(payload) == fields["WARC-Payload-Digest"], payload.decode()))
            size += len(payload)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, file_bytes: int = FILE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> None:
    """Archive every page under ``path``, a URI; a folder that holds archives gets more of them.

    Ids are integers.  Rows without html (null) were never captured and give no record; an empty page gives an
    empty block.  A null or empty URL is archived under a URN of the page's id and read back as
    null; a null id has no id field.  White space and control characters of a URL are
    percent-encoded.  Repeated rows are repeated records, each with an id of its own.
    Long pages are one record, a file being closed after the record that fills it.  A file
    whose records are too few or too short for a dictionary has none.  An empty table gives
    an empty manifest; other columns are never looked at.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).where(F.col("html").isNotNull())
    settings = {"job": str(uuid.uuid4()), "date": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "filebytes": str(file_bytes), "dictionarybytes": str(dictionary_bytes)}
    rows.write.format(FORMAT).options(**settings).mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: where it lies, what it holds, and whether its digest is right.

    Null ids and URLs come back as null; empty pages as empty; repeated records repeatedly; long records
    whole.  Files that no manifest names are not read.  An archive of an empty table gives no rows.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).load(path)
