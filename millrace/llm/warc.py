"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Tasks write archives of their own into a shared folder, one gzip member for each record, under a
temporary name until they are whole; a repeated task writes the same bytes to the same name. The
reader checks every member and record, and where a check fails looks for the next valid member or
version line, goes on there and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.joins import attach_by_key
from millrace.plans.staging import stage

VERSION = b"WARC/1.1\r\n"
VERSION_MARK = b"WARC/1."
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Smaller payloads are stored again rather than referred to.
LEAST_SHARED = 100
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
GZIP_MAGIC = b"\x1f\x8b\x08"


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_shared: int = LEAST_SHARED) -> DataFrame:
    """``id, digest, first``: the rows whose payload of at least ``least_shared`` bytes occurs under a
    smaller id, with the smallest one. Only digests are compared and moved, never payloads; a payload
    that very many rows share is split over the tasks."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("p")).filter(F.octet_length("p") >= least_shared).select("id", F.sha2("p", 256).alias("digest"))
    rows = stage(rows, "warc-digests")
    shared = rows.groupBy("digest").agg(F.struct(F.min("id").alias("id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = attach_by_key(rows, stage(shared, "warc-shared"), "digest", "n", "first", F.col("id"))
    return stage(later.select("id", "digest", F.col("first.id").alias("first")).filter("id > first").distinct(), "warc-revisits")


def _fields(pairs: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def record(record_id: object, uri: str | None, payload: bytes, first: object, is_revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response with it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    name = lambda i: f"<urn:record:{'' if i is None else quote(str(i))}>"
    return VERSION + _fields([
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", name(record_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if uri is None else quote(uri, safe=":/?#[]@!$&'()*+,;=%")),
        ("WARC-Refers-To", name(first) if is_revisit else None),
        ("WARC-Profile", PROFILE if is_revisit else None),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]) + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archive:
    """A file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.path, self.uri = f"{root}/{name}", f"{folder}/{name}"
        self.part = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.bytes = self.records = 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_archives(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, folder: str, compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write one record per row below ``folder``, a URI that all executors reach; returns the staged
    list ``path, bytes, records`` of the archives.

    Null payloads are empty. Of equal payloads of at least ``least_shared`` bytes the one of smallest
    id is a response and larger ids are revisits of it; rows that repeat the smallest id are responses
    too, and a null id is always a response. Archives are closed at about ``archive_bytes``. An empty
    table writes nothing. Other columns are ignored.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Spark broadcasts the staged list of revisits if its files are small and otherwise moves both sides by id.
    rows = rows.join(revisits(pages, id_col, payload_col, least_shared), ["id", "digest"], "left").select("id", "uri", "payload", "first")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, archive, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            ids, uris, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, payload in enumerate(batch.column(2)):
                data = record(ids[i], uris[i], payload.as_py(), firsts[i], firsts[i] is not None)
                if archive is None:
                    archive = _Archive(folder, f"part-{part:05d}-{number:05d}.warc" + ".gz" * compressed)
                    number += 1
                archive.add(gzip_member(data) if compressed else data)
                if archive.bytes >= archive_bytes:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_pydict({"path": pa.array([a.uri for a in done], pa.string()), "bytes": pa.array([a.bytes for a in done], pa.int64()), "records": pa.array([a.records for a in done], pa.int64())})

    return stage(rows.mapInArrow(written, "path string, bytes long, records long"), "warc-archives")


class Source:
    """Random access to an archive in bounded memory."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.at, self.data = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(n, CHUNK))
        return self.data[offset - self.at : offset - self.at + n]

    def find(self, pattern: bytes, offset: int) -> int:
        """Where ``pattern`` next begins, or the size."""
        while offset < self.size:
            data = self.read(offset, min(CHUNK, self.size - offset))
            at = data.find(pattern)
            if at >= 0:
                return offset + at
            offset += max(1, len(data) - len(pattern) + 1)
        return self.size


class Damage(Exception):
    """A check that failed; the message is the gap's reason."""


UNCHECKED = "(unchecked)"
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


def digest_check(value: str | None, data: bytes) -> bool | None:
    """Whether a digest such as ``sha1:<base32>`` fits the data, written in base 16, 32 or 64; none at
    all fits. None if its kind is not known, so nothing can be said."""
    kind, _, wanted = (value or "").partition(":")
    kind, wanted = kind.strip().lower().replace("-", ""), wanted.strip().rstrip("=")
    if not kind:
        return True
    if kind not in DIGESTS:
        return None
    digest = hashlib.new(kind, data, usedforsecurity=False).digest()
    written = (digest.hex(), base64.b32encode(digest).decode().rstrip("=").lower())
    return wanted.lower() in written or wanted == base64.b64encode(digest).decode().rstrip("=")


def parse(source: Source, offset: int) -> tuple[dict[str, str], bytes, int]:
    """``(fields, payload, end)`` of the record at ``offset``; raises ``Damage`` if a check fails."""
    if source.read(offset, 7) != VERSION_MARK:
        raise Damage("no version line")
    stop = source.find(b"\r\n\r\n", offset)
    if stop >= source.size:
        raise Damage("header without end")
    lines = source.read(offset, stop - offset).split(b"\r\n")[1:]
    fields = {}
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header line")
        fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Damage("bad length")
    begin, end = stop + 4, stop + 4 + int(length)
    if end + 4 > source.size or source.read(end, 4) != b"\r\n\r\n":
        raise Damage("record without end")
    block = source.read(begin, int(length))
    unknown = []

    def check(name: str, data: bytes) -> None:
        fits = digest_check(fields.get(f"warc-{name}-digest"), data)
        if fits is None:
            unknown.append(f"unchecked {name} digest")
        elif not fits:
            raise Damage(f"{name} digest")

    check("block", block)
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if fields.get("warc-type") != "revisit":
        check("payload", payload)
    # A field of no archive, as names are letters and hyphens.
    fields[UNCHECKED] = ", ".join(unknown)
    return fields, payload, end + 4


def inflate(source: Source, offset: int) -> tuple[bytes, int]:
    """``(data, end)`` of the gzip member at ``offset``; raises ``Damage`` if it is not whole."""
    if source.read(offset, 3) != GZIP_MAGIC:
        raise Damage("no member")
    reader, out, at = zlib.decompressobj(31), [], offset
    while not reader.eof:
        data = source.read(at, min(CHUNK, source.size - at))
        if not data:
            raise Damage("member without end")
        try:
            out.append(reader.decompress(data))
        except zlib.error:
            raise Damage("bad member") from None
        at += len(data)
    return b"".join(out), at - len(reader.unused_data)


class _Marks:
    """Where the next of several patterns begins; each is looked for once."""

    def __init__(self, source: Source, patterns: tuple[bytes, ...]) -> None:
        self.source, self.next = source, dict.fromkeys(patterns, -1)

    def after(self, offset: int) -> int:
        for pattern, at in self.next.items():
            if at < offset:
                self.next[pattern] = self.source.find(pattern, offset)
        return min(self.next.values())


def _salvaged(source: Source, take, marks: tuple[bytes, ...]) -> Iterator[tuple]:
    """What ``take(source, offset)`` yields from one valid place to the next: ``(offset, end, value)``,
    and ``(offset, end, reason)`` with a string for the bytes between."""
    offset, places = 0, _Marks(source, marks)
    while offset < source.size:
        try:
            value, end = take(source, offset)
            yield offset, end, value
            offset = end
            continue
        except Damage as damage:
            reason = str(damage)
        resume = places.after(offset + 1)
        while resume < source.size:
            try:
                take(source, resume)
                break
            except Damage:
                resume = places.after(resume + 1)
        yield offset, resume, reason
        offset = resume


def _record(source: Source, offset: int) -> tuple[list, int]:
    fields, payload, end = parse(source, offset)
    return [(fields, payload)], end


def _member(source: Source, offset: int) -> tuple[list, int]:
    """The records of a member; damage inside it counts only if no record is left."""
    data, end = inflate(source, offset)
    inner = Source(pa.BufferReader(data))
    found = list(_salvaged(inner, _record, (VERSION_MARK,)))
    records = [r for _, _, value in found if not isinstance(value, str) for r in value]
    lost = [value for _, _, value in found if isinstance(value, str)]
    if not records:
        raise Damage(lost[0] if lost else "empty member")
    return records + [(None, reason) for reason in lost], end


def _either(source: Source, offset: int) -> tuple[list, int]:
    """Members and bare records are told apart where they begin, so a damaged start decides nothing."""
    return (_member if source.read(offset, 3) == GZIP_MAGIC else _record)(source, offset)


def entries(source: Source) -> Iterator[tuple]:
    """``(kind, offset, length, fields, payload, reason)`` of an archive; kind is record or gap."""
    for offset, end, value in _salvaged(source, _either, (GZIP_MAGIC, VERSION_MARK)):
        if isinstance(value, str):
            yield "gap", offset, end - offset, {}, None, value
            continue
        for fields, payload in value:
            if fields is None:
                yield "gap", offset, end - offset, {}, None, f"in member: {payload}"
            else:
                yield "record", offset, end - offset, fields, payload, fields[UNCHECKED] or None


def read_archives(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """All entries of the archives named in a column: ``path, kind, offset, length, record_type,
    record_id, refers_to, uri, payload, payload_digest, reason``.

    A ``gap`` is a range of bytes that no check passed for, with the reason of the first failure; the
    records after it are recovered. A record whose digest is of an unknown kind says so as its reason. Bytes inside a valid member are reported at the member's place.
    One task reads an archive, in steps of bounded size; a single record is held whole. Null paths
    and empty files give no entries.
    """
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = archives.select(F.col(path_col).alias("path")).filter("path is not null").repartition(parts, F.xxhash64("path"))
    kinds = [("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
             ("refers_to", pa.string()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("reason", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as file:
                    for kind, offset, length, fields, payload, reason in entries(Source(file)):
                        get = fields.get
                        rows.append((uri, kind, offset, length, get("warc-type"), get("warc-record-id"), get("warc-refers-to"), get("warc-target-uri"), payload, get("warc-payload-digest"), reason))
                        held += len(payload or b"")
                        if held >= 4 << 20 or len(rows) >= 5000:
                            yield flush()
                            rows, held = [], 0
        yield flush()

    return paths.mapInArrow(read, "path string, kind string, offset long, length long, record_type string, record_id string, refers_to string, uri string, payload binary, payload_digest string, reason string")


def resolved(found: DataFrame, id_type: str) -> DataFrame:
    """``id, record_type, payload_bytes, payload_digest, refers_to`` of all records read: revisits get
    their length from the response they refer to (null if it was lost) and their digest from
    their own header, responses both from the payload itself."""
    from_urn = lambda c: F.expr(f"try_cast(nullif(url_decode(regexp_extract({c}, '^<urn:record:(.*)>$', 1)), '') as {id_type})")
    is_revisit = F.col("record_type") == "revisit"
    rows = found.filter("kind = 'record'").select(
        from_urn("record_id").alias("id"), "record_type",
        F.when(~is_revisit, F.octet_length("payload").cast("long")).alias("own_bytes"),
        F.when(is_revisit, F.substring_index("payload_digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.when(is_revisit, from_urn("refers_to")).alias("refers_to"),
    )
    rows = stage(rows, "warc-records")
    responses = rows.filter(~is_revisit).select(F.col("id").alias("refers_to"), "payload_digest", F.col("own_bytes").alias("first_bytes")).dropDuplicates(["refers_to", "payload_digest"])
    again = rows.filter(is_revisit)
    uses = stage(again.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n")).join(responses, ["refers_to", "payload_digest"])
                 .select(F.struct("refers_to", "payload_digest").alias("key"), "n", F.struct("first_bytes").alias("found")), "warc-uses")
    sized = attach_by_key(again.withColumn("key", F.struct("refers_to", "payload_digest")), uses, "key", "n", "found", F.col("id"))
    lost = again.join(uses.select("key.refers_to", "key.payload_digest"), ["refers_to", "payload_digest"], "left_anti")
    columns = ["id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    return (
        rows.filter(~is_revisit).withColumn("payload_bytes", F.col("own_bytes")).select(columns)
        .union(sized.withColumn("payload_bytes", F.col("found.first_bytes")).select(columns))
        .union(lost.withColumn("payload_bytes", F.col("own_bytes")).select(columns))
    )
