"""WARC archives, written and read as rows of records in chunks.

A payload is rows of (record, chunk, data) of at most ``CHUNK`` bytes; lengths and digests are carried from chunk to chunk, so no
task holds a whole payload.  What stands in the header of a record (type, length, digest, the record it refers to) comes as a row
before its chunks.  ``warc`` is a data source: the writer appends chunks as they come and closes an archive after ``ARCHIVE`` bytes;
the reader inflates an archive piece by piece and gives chunks, or one row for each record.  Each record is a gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

#: Bytes of a chunk, of an archive after which the next one begins, and of what is read at once; level of compression.
CHUNK, ARCHIVE, PIECE, LEVEL = 1 << 20, 256 << 20, 1 << 18, 6
#: Bytes that the head of a record may have.
HEAD = 1 << 16
_CHUNKED = "record long, page_id long, url string, chunk int, data binary, n long, sha1 binary, sha256 binary"
_RECORDS = "archive string, record_id string, kind string, url string, refers_to string, payload_bytes long, payload_digest string, intact boolean"
_CHUNKS = "archive string, record_id string, chunk int, data binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, record: int) -> str:
    """A page and the row that it came from, which tells repeated pages apart."""
    return f"<urn:page:{'' if page_id is None else page_id}:{record}>"


def _line(text: str) -> str:
    """A header's value: what is no visible ASCII becomes %XX, so that nothing in it ends the line."""
    return urllib.parse.quote(text, safe="".join(map(chr, range(0x21, 0x7F))), errors="surrogatepass")


def header(kind: str, identifier: str, date: str, url: str | None, digest: str | None, refers: str | None, length: int, content: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    lines += [f"Content-Type: {content}", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    """The reply before a payload; a revisit has it alone, so the length of its payload is known from it."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


# Payloads in chunks -------------------------------------------------------------------------------------------------


def chunked(pages: DataFrame, chunk: int = CHUNK, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Rows (record, page_id, url, chunk, data, n, sha1, sha256) of every payload, in order within a record; the last chunk has length and
    digests.  ``record`` tells rows apart, also repeated ones; since it counts rows of partitions, store the table before it is read twice."""
    from pyspark import TaskContext

    def scan(batches):
        number = TaskContext.get().partitionId() << 33
        schema = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("n", pa.int64()), ("sha1", pa.binary()), ("sha256", pa.binary())])
        rows, size = [], 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary())
            for page, address, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                held = text.as_buffer()
                view, sha1, sha256, low, k = memoryview(held) if held is not None else memoryview(b""), hashlib.sha1(), hashlib.sha256(), 0, 0
                while True:
                    part = view[low : low + chunk]
                    sha1.update(part)
                    sha256.update(part)
                    low, size = low + len(part), size + len(part)
                    last = low >= len(view)
                    rows.append((number, page, address if last else None, k, part, *((low, sha1.digest(), sha256.digest()) if last else (None, None, None))))
                    if size >= 4 * chunk or len(rows) >= 10_000:
                        yield closed()
                        rows, size = [], 0
                    if last:
                        break
                    k += 1
                number += 1
        if rows:
            yield closed()

    return pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[payload].cast("string").alias("html")).mapInArrow(scan, _CHUNKED)


def decided(rows: DataFrame, revisit_from: int = 0) -> DataFrame:
    """One row for each record: kind, and for revisits the page and the record that they refer to.  Of equal payloads of at least
    ``revisit_from`` bytes, the record of the smallest page is the response (of these the first row; a null page comes last); payloads
    are equal if length, SHA-1 and SHA-256 are."""
    last = rows.filter("n IS NOT NULL").select("record", "page_id", "url", "n", "sha1", "sha256")
    place = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("record").alias("row"))
    firsts = last.filter(F.col("n") >= revisit_from).groupBy("n", "sha1", "sha256").agg(F.min(place).alias("first"))
    joined = last.join(firsts, ["n", "sha1", "sha256"], "left")
    again = F.col("first.row") != F.col("record")
    return joined.select("record", "page_id", "url", "n", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first.page")).alias("refers_page"), F.when(again, F.col("first.row")).alias("refers_record"))


def laid_out(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """What the writer takes: the row of a record's head, then its chunks (those of responses), records together and in order."""
    digest = F.hex("sha1")
    heads = decisions.select("record", F.lit(-1).alias("chunk"), "page_id", "url", "kind", "refers_page", "refers_record", "n", digest.alias("digest"), F.lit(None).cast("binary").alias("data"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("page_id", "long"), ("url", "string"), ("kind", "string"), ("refers_page", "long"), ("refers_record", "long"), ("n", "long"), ("digest", "string"))]
    both = heads.unionByName(rows.filter(F.length("data") > 0).select("record", "chunk", *none, "data"))
    return both.repartition(F.col("record")).sortWithinPartitions("record", "chunk")


# Files --------------------------------------------------------------------------------------------------------------


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs), or this machine's for a plain path, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Archive:
    """An open archive; a record's member is fed piece by piece."""

    def __init__(self, system: fs.FileSystem, path: str, date: str) -> None:
        self.file, self.size, self.member, self.date = system.open_output_stream(path, compression=None), 0, None, date
        info = b"software: rows of records in chunks\r\nformat: WARC File Format 1.1\r\n"
        self.open(header("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, None, None, None, len(info), "application/warc-fields") + info)
        self.end()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def open(self, head: bytes) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._put(self.member.compress(head))

    def add(self, data) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        if self.member:
            self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.member = None


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own name; they get their last names when all tasks are done, and what attempts
    without success left is deleted then.  The driver holds the names of archives alone."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.date, self.most, self.run = path, options.get("date", "1970-01-01T00:00:00Z"), int(options.get("archive", ARCHIVE)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = filesystem(self.path)
        held = f"{folder}/_attempts-{self.run}"
        system.create_dir(held, recursive=True)
        context, names, archive, left = TaskContext.get(), [], None, 0
        for batch in iterator:
            for row in range(batch.num_rows):
                record, chunk, page, url, kind, refers_page, refers, n, digest, data = (batch.column(k)[row] for k in range(10))
                if chunk.as_py() < 0:
                    if archive and left:
                        raise ValueError("a record has fewer bytes than its head says")
                    if archive:
                        archive.end()
                    if archive and archive.size >= self.most:
                        archive.file.close()
                        archive = None
                    if not archive:
                        names.append(f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(names):04d}.warc.gz")
                        archive = _Archive(system, f"{held}/{names[-1]}", self.date)
                    revisit, length = kind.as_py() == "revisit", n.as_py()
                    reply = http_head(length)
                    left = 0 if revisit else length
                    archive.open(header(kind.as_py(), record_id(page.as_py(), record.as_py()), self.date, url.as_py(), base32(bytes.fromhex(digest.as_py())), record_id(refers_page.as_py(), refers.as_py()) if revisit else None, len(reply) + left, "application/http; msgtype=response") + reply)
                elif left:  # payloads of revisits are not stored
                    part = memoryview(data.as_buffer())
                    archive.add(part)
                    left -= len(part)
        if archive:
            if left:
                raise ValueError("a record has fewer bytes than its head says")
            archive.end()
            archive.file.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{folder}/_attempts-{self.run}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = filesystem(self.path)
        held = f"{folder}/_attempts-{self.run}"
        if system.get_file_info(held).type == fs.FileType.Directory:
            system.delete_dir(held)


class _Stream:
    """The bytes of an archive, inflated where they are gzip members, of which only a few pieces are held."""

    def __init__(self, file) -> None:
        self.file, self.buffer, self.member, self.raw, self.plain = file, bytearray(), None, b"", None

    def _more(self) -> bool:
        """Take in a further piece; false at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(PIECE)
                if not self.raw:
                    rest = self.member.flush() if self.member else b""
                    if self.member and not self.member.eof:
                        raise ValueError("the archive ends within a member")
                    self.member = None
                    self.buffer += rest
                    return bool(rest)
            if self.plain is None:
                self.plain = self.raw[:2] != b"\x1f\x8b"
            if self.plain:
                self.buffer += self.raw
                self.raw = b""
                return True
            if self.member is None:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(self.raw, PIECE)
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            if got:
                self.buffer += got
                return True

    def head(self) -> bytes | None:
        """Up to an empty line, without empty lines before it; None at the end of the archive."""
        while not self.buffer or self.buffer[:1] in (b"\r", b"\n"):
            del self.buffer[: len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))]
            if not self.buffer and not self._more():
                return None
        seen = 0
        while (at := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if seen > HEAD:
                raise ValueError(f"a head of over {HEAD} bytes")
            if not self._more():
                raise ValueError("the archive ends within a head")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


def fields_of(head: bytes) -> dict[str, str]:
    """Names, in lower case, and values of the lines after the first; a line that begins with white space goes on with the last."""
    out, name = {}, ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            out[name] = f"{out.get(name, '')} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(stream: _Stream, chunk: int) -> Iterator[tuple[dict, list[tuple[int, bytes]] | None]]:
    """(fields of the record, a piece of its payload) again and again, and (fields, None) at its end, when they hold ``n``, ``digest``."""
    while (head := stream.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = fields_of(head)
        left, sha1, n = int(fields["content-length"]), hashlib.sha1(), 0
        if fields.get("content-type", "").startswith("application/http"):
            reply, pieces = b"", stream.take(left)
            while (at := reply.find(b"\r\n\r\n")) < 0:
                if len(reply) > HEAD:
                    raise ValueError(f"a head of over {HEAD} bytes")
                if not (piece := next(pieces, b"")):
                    break
                reply += piece
            body = reply[at + 4 :] if at >= 0 else b""
            fields["http"] = fields_of(reply[:at]) if at >= 0 else {}
        else:
            body, pieces = b"", stream.take(left)
        held, k = bytearray(), 0
        for piece in ([body] if body else []), pieces:
            for part in piece:
                sha1.update(part)
                n += len(part)
                held += part
                while len(held) >= chunk:
                    yield fields, (k, bytes(held[:chunk]))
                    del held[:chunk]
                    k += 1
        if held:
            yield fields, (k, bytes(held))
        fields["n"], fields["digest"] = n, base32(sha1.digest())
        yield fields, None


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """A partition for each archive; the driver lists names, no contents."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.rows, self.chunk = path, options.get("rows", "records"), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        system, folder = filesystem(self.path)
        if system.get_file_info(folder).type == fs.FileType.File:
            return [ArchiveFile(folder)]
        found = system.get_file_info(fs.FileSelector(folder))
        return [ArchiveFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.base_name)]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        system, _ = filesystem(self.path)
        name = partition.path.rpartition("/")[2]
        with system.open_input_stream(partition.path, compression=None) as file:
            yield from (self._chunks if self.rows == "chunks" else self._records)(name, records(_Stream(file), self.chunk))

    def _chunks(self, name: str, found) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("chunk", pa.int32()), ("data", pa.binary())])
        for fields, piece in found:
            if piece:
                yield common.batch_of(schema, archive=[name], record_id=[fields.get("warc-record-id")], chunk=[piece[0]], data=[piece[1]])

    def _records(self, name: str, found) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
        rows: list[tuple] = []
        for fields, piece in found:
            if piece:
                continue
            kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
            if kind == "revisit":
                length = fields.get("http", {}).get("content-length")
                n, digest, intact = int(length) if length else None, said, fields["n"] == 0
            else:
                n, digest, intact = fields["n"], fields["digest"], said in (None, fields["digest"])
            rows.append((name, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), n, digest, intact))
            if len(rows) >= 5000:
                yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                rows = []
        if rows:
            yield common.batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))


class WarcSource(DataSource):
    """``format("warc")``: options of reading are ``rows`` (``records``: one row for each; ``chunks``: payloads) and
    ``chunk`` (bytes), of writing ``date`` and ``archive`` (bytes after which a file is closed)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _CHUNKS if self.options.get("rows") == "chunks" else _RECORDS

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WarcSource)
    return spark


def write(pages: DataFrame, path: str, revisit_from: int = 0, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z", archive: int = ARCHIVE, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archives of all pages in the folder ``path``, a record for each row; of equal payloads one record is stored, the others revisit it.

    A null payload is an empty one; a null url is left out; null page ids come last among equal payloads and repeated rows are records
    of their own; other columns aren't read; an empty table gives no archive.
    """
    spark = registered(pages.sparkSession)
    rows, held = common.staged_at(chunked(pages, chunk, key, url, payload), "warc-chunks", "zstd")
    laid_out(rows, decided(rows, revisit_from)).write.format("warc").mode("append").option("date", date).option("archive", archive).save(path)
    common.removed(spark, held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder, without those that describe an archive: archive, record_id, kind, url, refers_to,
    payload_bytes and payload_digest of the full payload (of revisits as their head says), intact (stored digest and bytes agree)."""
    return registered(spark).read.format("warc").load(path).filter("kind <> 'warcinfo'")


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The payloads: archive, record_id, chunk from 0, data of at most ``chunk`` bytes."""
    return registered(spark).read.format("warc").option("rows", "chunks").option("chunk", chunk).load(path)


def archived(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{common.shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write(pages, path, revisit_from)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):\d+>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))
