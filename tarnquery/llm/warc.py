"""WARC archives as a Spark data source written in Python: `spark.read.format("warc")` and `df.write.format("warc")`.

Each record is two gzip members, its headers and its block, and the first one's extra field holds the length of the
second. Any gzip reader sees a plain WARC file; this one parses the headers, tests the pushed filters on them and
steps over the block's member without inflating it when the record or its payload isn't wanted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from tarnquery.llm.session import join_small
from tarnquery.sources.shared import new_folder

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, intact boolean, payload binary, headers map<string,string>"
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string()))])
#: Columns that are headers of a record, so that filters on them are decided before a block is touched.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
#: Bytes of archives that a partition reads, unless one file is larger, and of payloads in a batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: The type of the row that stands for what can't be read of a file.
DAMAGED = "damaged"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Header of records whose values are written with escapes, as they would not be on one line otherwise.
ESCAPED = "X-Escaped"


def _plain(value: str) -> str:
    """A header value on one line, reversibly: control characters and backslashes as escapes."""
    return re.sub(r"[\x00-\x1f\x7f\\]", lambda m: f"\\x{ord(m[0]):02x}", value)


def _unescaped(headers: list[tuple[str, str]]) -> list[tuple[str, str]]:
    if ESCAPED not in (k for k, _ in headers):
        return headers
    return [(k, re.sub(r"\\x([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), v)) for k, v in headers if k != ESCAPED]


def _member(data: bytes, extra: bytes = b"") -> bytes:
    """A gzip member, with an extra field if there is one."""
    flags = 4 if extra else 0
    head = b"\x1f\x8b\x08" + bytes([flags]) + b"\0\0\0\0\0\xff" + (len(extra).to_bytes(2, "little") + extra if extra else b"")
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return head + packer.compress(data) + packer.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    body = _member(block + b"\r\n\r\n")
    if any(re.search(r"[\x00-\x1f\x7f]", v) for _, v in headers):
        headers = [(ESCAPED, "x"), *((k, _plain(v)) for k, v in headers)]
    lines = [*headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return _member(text.encode(), b"sl" + (8).to_bytes(2, "little") + len(body).to_bytes(8, "little")) + body


class _Stream:
    """Reads members of a gzip file one at a time, or raw bytes of a plain one, and can step over what isn't wanted."""

    def __init__(self, file):
        self.file, self.rest = file, b""
        self.packed = self._peek(2) == b"\x1f\x8b"
        self.inflated, self.unpacker, self.skip_to = b"", None, None

    def _peek(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.file.read(1 << 16)):
            self.rest += more
        return self.rest[:n]

    def _start(self) -> bool:
        """Begins the next member; its extra field may tell the length of the member after it."""
        head = self._peek(12)
        if len(head) < 10 or head[:2] != b"\x1f\x8b":
            if head.strip(b"\0"):
                raise EOFError("no member of the archive starts here")
            return False
        self.skip_to = None
        if head[3] & 4:
            size = int.from_bytes(head[10:12], "little")
            extra = self._peek(12 + size)[12:]
            if extra[:2] == b"sl" and size >= 12:
                self.skip_to = int.from_bytes(extra[4:12], "little")
        self.unpacker = zlib.decompressobj(31)
        return True

    def _fill(self) -> bool:
        if not self.packed:
            more = self.rest or self.file.read(1 << 16)
            self.rest = b""
            self.inflated += more
            return bool(more)
        if self.unpacker is None and not self._start():
            return False
        data = self.rest or self.file.read(1 << 16)
        self.rest = b""
        if not data:
            raise EOFError("the archive ends within a record")
        self.inflated += self.unpacker.decompress(data)
        if self.unpacker.eof:
            self.rest, self.unpacker = self.unpacker.unused_data, None
        return True

    def headers(self) -> list[tuple[str, str]] | None:
        while (end := self.inflated.find(b"\r\n\r\n")) < 0 or self.inflated[:end].strip() == b"":
            if end >= 0:
                self.inflated = self.inflated[end:].lstrip(b"\r\n")
                continue
            if not self._fill():
                if self.inflated.strip(b"\r\n\0"):
                    raise EOFError("the archive ends within a header")
                return None
        text, self.inflated = self.inflated[:end].decode("utf-8", "replace"), self.inflated[end + 4 :]
        lines: list[str] = []
        for x in text.lstrip("\r\n").split("\r\n")[1:]:
            if x[:1] in (" ", "\t") and lines:  # a folded line goes on with the one before
                lines[-1] += " " + x.strip()
            else:
                lines.append(x)
        return _unescaped([(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)])

    def block(self, size: int) -> bytes:
        parts, have = [self.inflated], len(self.inflated)
        while have < size:
            self.inflated = b""
            if not self._fill():
                raise EOFError("the archive ends within a record")
            parts.append(self.inflated)
            have += len(self.inflated)
        data = b"".join(parts)
        self.inflated = data[size:].lstrip(b"\r\n")
        return data[:size]

    def skip(self, size: int) -> None:
        if self.packed and self.unpacker is None and not self.inflated and self.skip_to is not None:
            step, self.skip_to = self.skip_to, None
            if step <= len(self.rest):
                self.rest = self.rest[step:]
            else:
                self.file.seek(self.file.tell() + step - len(self.rest))
                self.rest = b""
            return
        while size > len(self.inflated):
            size -= len(self.inflated)
            self.inflated = b""
            if not self._fill():
                raise EOFError("the archive ends within a record")
        self.inflated = self.inflated[size:].lstrip(b"\r\n")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(0)
        self.paths = tuple(paths)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes, self.wanted = path, payload, partition_bytes, []

    def pushFilters(self, filters):
        """Filters on header columns are decided here, before a block is read; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)):
                self.wanted.append((HEADERS[column], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=False)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted((x.path, x.size) for x in infos if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
        out, now, size = [], [], 0
        for path, n in files:
            if now and size + n > self.partition_bytes:
                out.append(Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*out, Files(now)] if now or not out else out

    def _fits(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.wanted:
            have = headers.get(name.lower())
            have = have.removeprefix("sha1:") if have is not None and name == HEADERS["payload_digest"] else have
            ok = {"EqualTo": lambda: have == value, "In": lambda: have in value, "IsNotNull": lambda: have is not None, "IsNull": lambda: have is None, "StringStartsWith": lambda: have is not None and have.startswith(value)}[kind]()  # noqa: B023
            if not ok:
                return False
        return True

    def _rows(self, path: str) -> Iterator[tuple]:
        """The records of a file that fit. Where it is cut off or damaged, the records before count and a row of type
        damaged, with the file as its target, stands for the rest."""
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(path) as file:
            stream = _Stream(file)
            try:
                while (lines := stream.headers()) is not None:
                    row = self._record(stream, lines)
                    if row is not None:
                        yield row
            except (EOFError, zlib.error):
                if self._fits({"warc-type": DAMAGED, "warc-target-uri": path}):
                    yield (None, DAMAGED, path, None, None, None, None, False, None, [])

    def _record(self, stream: _Stream, lines: list[tuple[str, str]]) -> tuple | None:
        headers = {k.lower(): v for k, v in lines}
        if not headers.get("content-length", "").isdecimal():
            raise EOFError("without its length the next record can't be found")
        size = int(headers["content-length"])
        if not self._fits(headers):
            stream.skip(size)
            return None
        known = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        is_http = headers.get("content-type", "").startswith("application/http")
        payload = intact = None
        said = headers.get("x-payload-length", "")
        length = int(said) if said.isdecimal() else None if is_http else size
        if self.payload and headers.get("warc-type") != "revisit":
            payload = stream.block(size)
            if is_http:
                payload = payload.partition(b"\r\n\r\n")[2]
            length = len(payload)
            intact = None if known is None else digest(payload) == known
        else:
            stream.skip(size)
        names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to")
        return (*[headers.get(n) for n in names], known, length, intact, payload, lines)

    def read(self, partition):
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)

        for path in partition.paths:
            for row in self._rows(path):
                rows.append(row)
                size += len(row[8] or b"") + 500
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Rows become records of a file for each task. Files get their names at commit, so a lost task leaves none behind.

    Columns: record_id, record_type, target_uri, date, refers_to, payload_sha1 (hexadecimal), payload_bytes, payload.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        name, out, fs = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_sha1", "payload_bytes", "payload")]
            for key, kind, uri, date, refers, known, size, payload in zip(*columns, strict=True):
                if out is None:
                    fs, root = pafs.FileSystem.from_uri(self.path)
                    fs.create_dir(f"{root}/_tmp")
                    out = fs.open_output_stream(f"{root}/_tmp/{name}", compression=None)
                headers = [("WARC-Type", kind), ("WARC-Record-ID", key), ("WARC-Date", date)]
                headers += [("WARC-Target-URI", uri)] if uri is not None else []
                headers += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(known)).decode()}"), ("X-Payload-Length", str(size))]
                if kind == "revisit":
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                out.write(record([*headers, ("Content-Type", "application/http; msgtype=response")], http + (b"" if kind == "revisit" else payload or b"")))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{root}/_tmp/{m.name}", f"{root}/{m.name}")
        self._clean(fs, root)

    def abort(self, messages):
        self._clean(*pafs.FileSystem.from_uri(self.path))

    @staticmethod
    def _clean(fs, root):
        if fs.get_file_info(f"{root}/_tmp").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_tmp")


class WarcDataSource(DataSource):
    """Options: path (a folder or file, as a URI), payload (false: headers only), partition_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives at path. Filters on record_type and other header columns are pushed into the reader.

    Header names are of either case, folded lines are joined. A file that ends within a record, or holds something else
    than records, gives those before and a row of type damaged; other files are read to their end. Without payloads a
    record that ends too early is only noticed where the next one should start. A file is read by one task.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """A record for each row, payload in UTF-8. Of rows with equal payloads of at least min_bytes the one with the
    smallest id is a response, the others are revisits of it without a payload; all other rows are responses.

    A null payload counts as empty, a null URL has no target header. Rows that repeat the smallest id are responses
    too; a row with a null id is a revisit if another row has its payload.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload"), F.sha1(body).alias("hexed"), F.octet_length(body).cast("long").alias("payload_bytes"))
    key = ["hexed", "payload_bytes"]
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = join_small(rows, first, key, "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:tarnquery:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    out = rows.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.col("hexed").alias("payload_sha1"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("path", path).save()


def id_of(urn: str) -> Column:
    return F.regexp_extract(urn, r"^<urn:tarnquery:(.*)>$", 1)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives to the shared folder and reads them back: a row for each page, ids of their own type.

    Null payloads count as empty, null URLs have no target. Repeated rows and null ids are as in write_warc; an id whose
    text can't be read as its type is null. Columns besides id, url and html aren't read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path, id_col, min_bytes=min_bytes)
    kind = dict(pages.dtypes)[id_col]
    back = read_warc(spark, path)
    number = lambda c: F.expr(f"try_cast({c} AS {kind})")
    return back.withColumns({"__id": id_of("record_id"), "__to": id_of("refers_to")}).select(number("__id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("__to").alias("refers_to"), "intact")
