"""WARC archives: a PySpark Python data source that writes and reads them.

Each record is a gzip member of its own, and the member's extra field tells its compressed length. The reader plans
partitions of files balanced by bytes, takes record-type and header predicates from the plan, inflates a record's header
first, and steps over a member whose record isn't wanted (or whose payload isn't, with option payload=false) without
inflating the rest. Members without that extra field, which
may hold several records, and archives that aren't compressed are read as well. Where there is no whole record (a stray line, a length that is
no number or more than there is, a member that ends early) reading fails with file and place; with option mode=permissive it
goes on at the next record, and what it left out is a row of type `skipped`.

Files are reached by the path's scheme: local or shared folders directly, other stores through pyarrow's file systems.
A task writes under a temporary name that the commit makes final, so tasks that are repeated leave no second copy.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tarnweave.llm.shared import saved, scratch

READ_SCHEMA = "file string, record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
#: Columns whose predicates are decided from the header alone.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
DATE = "1970-01-01T00:00:00Z"
#: Repeated payloads whose digests may be broadcast (about 100 MB).
BROADCAST_ROWS = 1 << 19
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Store:
    """The few file operations needed, on a local path or any store that pyarrow knows."""

    def __init__(self, path: str):
        scheme = urlparse(path).scheme
        self.fs = None
        if scheme in ("", "file"):
            self.root = urlparse(path).path if scheme else path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(path)

    def create(self, name: str):
        path = f"{self.root}/{name}"
        if self.fs:
            self.fs.create_dir(os.path.dirname(path), recursive=True)
            return self.fs.open_output_stream(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")

    def open(self, path: str):
        return self.fs.open_input_file(path) if self.fs else open(path, "rb")

    def move(self, name: str, to: str) -> None:
        a, b = f"{self.root}/{name}", f"{self.root}/{to}"
        self.fs.move(a, b) if self.fs else os.replace(a, b)

    def drop(self, name: str) -> None:
        path = f"{self.root}/{name}"
        try:
            self.fs.delete_file(path) if self.fs else os.remove(path)
        except OSError:
            pass

    def files(self) -> list[tuple[str, int]]:
        """All archives below the root, with their sizes."""
        if self.fs:
            from pyarrow import fs

            found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
            out = [(x.path, x.size) for x in found if x.is_file]
        elif os.path.isfile(self.root):
            out = [(self.root, os.path.getsize(self.root))]
        else:
            out = [(f"{d}/{x}", os.path.getsize(f"{d}/{x}")) for d, _, names in os.walk(self.root) for x in names]
        return sorted((p, n) for p, n in out if re.search(r"\.warc(\.gz)?$", p) and "/_temporary/" not in p)


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field TL has the length of the whole member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"TL", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(record_id: str, record_type: str, target_uri: str, refers_to: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """A response or revisit record of an HTTP exchange. Digests are given in hex and written in base 32, as is custom."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(target_uri)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files of about `roll` bytes, each by one task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.roll = options["path"], int(options.get("roll", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, names, out, size = Store(self.path), [], None, 0
        try:
            for batch in iterator:
                for r in batch.select(list(WRITE_COLUMNS)).to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.create(f"_temporary/{names[-1]}"), 0
                    data = member(record(r["record_id"], r["record_type"], r["target_uri"] or "", r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"] or b""))
                    out.write(data)
                    size += len(data)
                    if size >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store = Store(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"_temporary/{name}", name)

    def abort(self, messages: list[Written | None]) -> None:
        store = Store(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.drop(f"_temporary/{name}")


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if _}


class Malformed(ValueError):
    """No whole WARC record at a place of a file."""


class Stream:
    """Records of an archive, one after another: header first, the rest on demand. Where there is no whole record this raises; or, if `permissive`, goes on at the next place where a record begins and tells of what it left out as (None, reason, place, bytes)."""

    CHUNK = 1 << 16
    MOST_HEADER = 16 << 20

    def __init__(self, file, permissive: bool = False):
        self.file, self.at, self.permissive = file, 0, permissive
        self.end = file.seek(0, 2)

    def _read_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __iter__(self) -> Iterator[tuple]:
        records = self._records()
        while True:
            try:
                for fields in records:
                    yield fields, self
                return
            except (Malformed, zlib.error, EOFError) as e:
                if not self.permissive:
                    raise Malformed(f"no whole WARC record at byte {self.start}: {e}") from e
                begin, self.at = self.start, self._next(self.start + 1)
                yield None, str(e), begin, self.at - begin
                records = self._records()

    def _records(self) -> Iterator[dict[str, str]]:
        behind = None  # what a member has shown of what follows a record in it
        while True:
            if behind is None:
                self.start = self.at
                magic = self._read_at(self.at, 2)
                if not magic:
                    return
                self._begin(magic == b"\x1f\x8b")
            raw = behind or b""
            while b"\r\n\r\n" not in raw.lstrip(b"\r\n"):
                more = self._more(max(1 << 12, len(raw)))
                if not more:
                    break
                raw += more
                if not raw.lstrip(b"\r\n").startswith(b"WARC/"[: len(raw.lstrip(b"\r\n"))]) or len(raw) > self.MOST_HEADER:
                    break
            head = raw.lstrip(b"\r\n")
            if not head:  # nothing more in the file, or in the member
                if not self.packed:
                    return
                if not self.inflate.eof:
                    raise Malformed("a member that ends early")
                self.at, behind = self.place - len(self.inflate.unused_data), None
                continue
            if not self.packed:
                self.start += len(raw) - len(head)
            if not head.startswith(b"WARC/") or b"\r\n\r\n" not in head:
                raise Malformed(f"no header in {head[:40]!r}")
            cut = head.index(b"\r\n\r\n") + 4
            fields = _headers(head[: cut - 4])
            length = fields.get("content-length", "")
            if not re.fullmatch("[0-9]+", length):
                raise Malformed(f"Content-Length {length[:40]!r}")
            self._rest, self._length = head[cut:], int(length)
            yield fields
            behind = self._skip(cut)

    def _next(self, at: int) -> int:
        """The next place where a record or a member with one begins, or the end."""
        keep = 16
        while at < self.end:
            data = self._read_at(at, self.CHUNK + keep)
            for m in re.finditer(rb"\x1f\x8b\x08|(?<=\n)WARC/[0-9.]+\r\n", data):
                if m.start() >= self.CHUNK:
                    break
                if m[0].startswith(b"W") or self._opens(at + m.start()):
                    return at + m.start()
            at += self.CHUNK
        return self.end

    def _opens(self, at: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self._read_at(at, 1 << 12), 64).lstrip(b"\r\n").startswith(b"WARC/")
        except zlib.error:
            return False

    def _begin(self, packed: bool) -> None:
        self.packed, self.size = packed, None
        if packed:
            fixed = self._read_at(self.at, 24)
            if len(fixed) == 24 and fixed[3] & 4 and fixed[12:14] == b"TL":
                self.size = struct.unpack("<Q", fixed[16:24])[0]
                if self.at + self.size > self.end or self.size < 24:
                    raise Malformed(f"a member of {self.size} bytes where the file has {self.end - self.at}")
            self.inflate, self.place, self.tail = zlib.decompressobj(31), self.at, b""
        else:
            self.place = self.at

    def _more(self, n: int) -> bytes:
        """Up to n further bytes of the record."""
        if not self.packed:
            data = self._read_at(self.place, n)
            self.place += len(data)
            return data
        while not self.inflate.eof:
            if not self.tail:
                self.tail = self._read_at(self.place, self.CHUNK)
                self.place += len(self.tail)
                if not self.tail:
                    return b""
            out = self.inflate.decompress(self.tail, n)
            self.tail = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def block(self) -> bytes:
        """The record's block, whole."""
        parts, n = [self._rest], len(self._rest)
        while n < self._length:
            more = self._more(self._length - n)
            if not more:
                raise Malformed(f"a block of {n} bytes where the header says {self._length}")
            parts.append(more)
            n += len(more)
        self._rest = b"".join(parts)
        return self._rest[: self._length]

    def _skip(self, header: int) -> bytes | None:
        """Goes behind the record, whose header takes so many bytes; if it is in a member that may hold more, gives what has been read of that."""
        if not self.packed:
            self.at = self.start + header + self._length
            if self.at > self.end:
                raise Malformed(f"a block of {self._length} bytes where the file has {self.end - self.start - header}")
        elif self.size:
            self.at = self.start + self.size
        else:
            n = len(self._rest)
            while n < self._length and (more := self._more(min(self.CHUNK, self._length - n))):
                n += len(more)
            if n < self._length:
                raise Malformed(f"a block of {n} bytes where the header says {self._length}")
            return self._rest[self._length :]
        return None


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    """Rows of READ_SCHEMA from the records that pass the predicates. With mode=permissive, what holds no whole record is a row of type `skipped`, with its length in payload_bytes and reason and place among the headers."""

    def __init__(self, options: dict[str, str]):
        self.path, self.target = options["path"], int(options.get("partition_bytes", 64 << 20))
        self.permissive = str(options.get("mode", "failfast")).lower() == "permissive"
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if isinstance(f, EqualTo) and column in HEADER_OF:
                self.wanted.append((HEADER_OF[column], [f.value]))
            elif isinstance(f, In) and column in HEADER_OF:
                self.wanted.append((HEADER_OF[column], list(f.value)))
            else:
                if isinstance(f, IsNotNull) and column in HEADER_OF:
                    self.wanted.append((HEADER_OF[column], []))
                yield f

    def partitions(self) -> list[Files]:
        """Files, largest first, each to the bundle with the fewest bytes."""
        found = sorted(Store(self.path).files(), key=lambda x: -x[1])
        bundles = [[0, []] for _ in range(max(1, min(len(found), -(-sum(n for _, n in found) // self.target))))]
        for name, size in found:
            least = min(bundles, key=lambda b: b[0])
            least[0] += size
            least[1].append(name)
        return [Files(names) for _, names in bundles]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), *((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        store, rows, size = Store(self.path), [], 0
        for name in partition.names:
            with store.open(name) as file:
                for fields, at, *rest in self._stream(file, name):
                    if fields is None:
                        plain = {"warc-type": "skipped", "reason": at, "place": str(rest[0]), "content-length": str(rest[1])}
                    else:
                        plain = fields | {k: fields[k].strip("<>") for k in ("warc-record-id", "warc-refers-to") if k in fields}
                    if not all(k in plain and (not values or plain[k] in values) for k, values in self.wanted):
                        continue
                    try:
                        rows.append(self._row(name, plain, at))
                    except (Malformed, zlib.error) as e:
                        if not self.permissive:
                            raise Malformed(f"{name}, byte {at.start}: {e}") from e
                        if not (at.packed and at.size):
                            continue  # the stream tells of it, as it looks for the next record
                        rows.append(self._row(name, {"warc-type": "skipped", "reason": str(e), "place": str(at.start), "content-length": str(at.size)}, None))
                    size += 500 + len(rows[-1]["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _stream(self, file, name: str) -> Iterator[tuple]:
        try:
            yield from Stream(file, self.permissive)
        except Malformed as e:
            raise Malformed(f"{name}: {e}") from e

    def _row(self, name: str, fields: dict[str, str], at: Stream | None) -> dict:
        kind = fields.get("warc-type")
        body = length = None
        if kind == "skipped":
            length = int(fields["content-length"])
        elif self.payload or kind == "revisit":
            http, _, body = at.block().partition(b"\r\n\r\n")
            stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
            length = int(stated[1]) if stated else len(body)
        digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
        if len(digest) == 32:
            digest = base64.b32decode(digest).hex()
        return {
            "file": name, "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": digest.lower(), "payload_bytes": length, "headers": list(fields.items()), "payload": body if self.payload and kind not in ("revisit", "skipped") else None,
        }


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def record_name(page: F.col) -> F.col:
    return F.coalesce(F.concat(F.lit("urn:page:"), page.cast("string")), F.concat(F.lit("urn:uuid:"), F.uuid()))


def planned(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for the writer: of pages with equal payloads of at least `least_bytes` bytes, that with the largest id is the response that the others revisit; one of those with that id, if it is repeated. Rows with a null id revisit as well, but if all of them are such, each is a response."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))
    # One row for each payload that occurs again: partly aggregated before the shuffles, so copies cost little.
    by_page = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes", "page").agg(F.count("*").alias("n"))
    keep = by_page.groupBy("payload_digest", "payload_bytes").agg(F.max("page").alias("first"), F.max_by("n", "page").alias("n_first"), F.sum("n").alias("n")).where("n > 1 and first is not null").drop("n")
    keep = saved(keep, "warc-repeated")
    # Rows of fixed size: few of them are broadcast, and payloads then cross no shuffle.
    joined = rows.join(F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep, ["payload_digest", "payload_bytes"], "left")
    own = F.col("page").eqNullSafe(F.col("first"))
    tied = F.coalesce(own & (F.col("n_first") > 1), F.lit(False))
    again = F.col("first").isNotNull() & ~own
    columns = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
    records = joined.where(~tied).select(
        record_name(F.col("page")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, record_name(F.col("first"))).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )
    if keep.where("n_first > 1").isEmpty():
        return records
    # Rows that share the largest id and the payload: one of them, of the smallest address, is the response. They differ in addresses only, so they are counted and not ranked.
    key = ["payload_digest", "payload_bytes", "page"]
    same = joined.where(tied)
    lead = same.groupBy(*key).agg(F.min(F.struct("target_uri")).alias("lead"), F.min("payload").alias("payload"))
    more = same.groupBy(*key, "target_uri").agg(F.count("*").alias("n")).join(lead.drop("payload"), key)
    more = more.select("*", F.explode(F.array_repeat(F.lit(0), (F.col("n") - F.when(F.col("target_uri").eqNullSafe(F.col("lead.target_uri")), 1).otherwise(0)).cast("int"))))
    name = record_name(F.col("page"))
    responses = lead.select(name.alias("record_id"), F.lit("response").alias("record_type"), "lead.target_uri", F.lit(None).cast("string").alias("refers_to"), "payload_digest", "payload_bytes", "payload")
    revisits = more.select(name.alias("record_id"), F.lit("revisit").alias("record_type"), "target_uri", name.alias("refers_to"), "payload_digest", "payload_bytes", F.lit(None).cast("binary").alias("payload"))
    return records.select(*columns).unionAll(responses).unionAll(revisits)


def archive(pages: DataFrame, path: str | None = None, nameless: bool = False, **options) -> str:
    """Writes a record for each row of pages; gives the folder. Null html is an empty payload; rows with a null id get none, or with `nameless` a record under a generated urn:uuid; equal rows get a record each; an empty table leaves an empty folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    rows = pages if nameless else pages.where(F.col(options.get("id_col", "page_id")).isNotNull())
    planned(rows, **options).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True, mode: str = "failfast") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("mode", mode).load(path)
