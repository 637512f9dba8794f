"""WARC archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files, about ``split_bytes`` each.  Predicates on the
record type and on headers (``=``, ``IN``, null-safe ``=``) are pushed to the reader, which
parses a record's headers first; a payload is only decoded if the record passes and the
schema asks for ``payload``.  An unwanted one is skipped by its Content-Length, or in
compressed archives by the length that the writer leaves in each gzip member (the ``sl``
field); members without it are inflated and dropped.

Writing makes a file per task, rolled over at ``file_bytes``, in a temporary folder; the
commit moves files to their place and an abort removes them, so that lost executors and
repeated tasks leave no part of a file.

Files are opened through Arrow's filesystems (local, HDFS, S3, GCS, Azure) by the scheme
of the path.

Defined results: rows that share the largest page_id of their payload are all responses; a null payload is an empty one; null headers are not written and read as
null; line ends in header values become blanks, but for ids, which are percent-encoded.  A record cut off at the end of a file, or
a malformed one, raises ``ValueError`` with the file's name.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage

from .scratch import new_path, table

#: Columns of a record and the headers they are from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'payload_length' else 'string'}" for c in HEADERS) + ", payload binary"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES, FILE_BYTES = 32 << 20, 128 << 20
#: Digests of repeated payloads that may be broadcast; more are joined.
BROADCAST_DIGESTS = 500_000
#: Bytes of the longest member that can tell its length.
MOST_SKIPPED = 2**32 - 1
#: Bytes of payload in a batch.
BATCH_BYTES = 16 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- records


def encode(columns: dict, payload: bytes | None) -> bytes:
    """A whole record, uncompressed."""
    kind = columns.get("record_type") or "response"
    payload = payload or b""
    if kind in ("response", "revisit"):
        length = columns.get("payload_length")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
        block += payload
        content = "application/http; msgtype=response"
    else:
        block, content = payload, "application/warc-fields"
    lines = [VERSION]
    for column, header in HEADERS.items():
        value = columns.get(column)
        if column == "record_type":
            value = kind
        if value is not None:
            lines.append(f"{header}: {' '.join(str(value).splitlines())}".encode())
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}".encode())
    lines += [f"Content-Type: {content}".encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length, compressed and not, unless they are too long for that."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    if max(size, len(record)) > MOST_SKIPPED:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    extra = struct.pack("<2sHII", b"sl", 8, size, len(record))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Inflated(io.RawIOBase):
    """One gzip member of ``source``, read as it is asked for."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.start, self.size = source, source.tell(), None
        head = source.read(12)
        if len(head) < 10 or head[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        if head[3] & 4:
            extra = source.read(struct.unpack("<H", head[10:12])[0])
            while len(extra) >= 4:
                name, n = struct.unpack("<2sH", extra[:4])
                if name == b"sl" and n == 8:
                    self.size = struct.unpack("<II", extra[4:12])[0]
                extra = extra[4 + n :]
        source.seek(self.start)
        self.z, self.left = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        while not self.z.eof:
            got = self.source.read(64 << 10)
            if not got:
                raise ValueError("cut off")
            if out := self.z.decompress(got):
                return out
        return b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.left:
            self.left = self.more()
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n

    def skip(self) -> None:
        """Go to the next member."""
        if self.size is not None:
            self.source.seek(self.start + self.size)
            return
        while not self.z.eof:
            self.more()
        self.source.seek(-len(self.z.unused_data), 1)


def _headers(stream) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record where one should begin: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("cut off")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _exactly(stream, n: int) -> bytes:
    out = stream.read(n)
    if len(out) < n:
        raise ValueError("cut off")
    return out


def records(raw, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(columns, payload) of each record that ``wanted(columns)``; the payload of others,
    and of all unless ``with_payload``, is passed over."""
    source = io.BufferedReader(raw, 1 << 20)
    while head := source.read(2):
        source.seek(-len(head), 1)
        zipped = _Inflated(source) if head == b"\x1f\x8b" else None
        stream = io.BufferedReader(zipped, 16 << 10) if zipped else source
        found = _headers(stream)
        if found is None:
            if zipped:
                zipped.skip()
                continue
            return
        columns = {c: found.get(h.lower()) for c, h in HEADERS.items()}
        if columns["payload_length"] is not None:
            columns["payload_length"] = int(columns["payload_length"])
        size = int(found.get("content-length", 0))
        keep = wanted(columns)
        if keep and with_payload:
            block = _exactly(stream, size)
            if found.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield columns, block
        elif keep:
            yield columns, None
        if zipped:
            zipped.skip()
        elif not (keep and with_payload):
            source.seek(size, 1)


# ---- the data source


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.schema, self.push = schema, options.get("pushdown", "false").lower() == "true"
        self.equal = [(name, frozenset(values)) for name, values in json.loads(options.get("only", "{}")).items()]

    def pushFilters(self, filters):
        for f in filters:
            name = None if not self.push else f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | EqualNullSafe):
                self.equal.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.equal.append((name, frozenset(f.value) - {None}))
            else:
                yield f

    def partitions(self):
        files, base = open_fs(self.path)
        info = files.get_file_info(base)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(base, recursive=True)) if info.type != pafs.FileType.NotFound else []
        found = sorted((f for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and "/_temporary" not in f.path[len(base) :]), key=lambda f: f.path)
        out, size = [[]], 0
        for f in found:
            if out[-1] and size + f.size > self.split:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(x) for x in out]

    def read(self, partition):
        files = open_fs(self.path)[0]
        kinds = {f.name: pa.int64() if f.dataType.typeName() == "long" else pa.binary() if f.name == "payload" else pa.string() for f in self.schema.fields}
        if unknown := set(kinds) - set(HEADERS) - {"payload"}:
            raise ValueError(f"a record has no {sorted(unknown)}")
        wanted = lambda c: all(c[name] in values for name, values in self.equal)
        batch = lambda rows: pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in kinds}, pa.schema(list(kinds.items())))
        for path in partition.paths:
            rows, size = [], 0
            with files.open_input_file(path) as raw:
                try:
                    for columns, payload in records(raw, wanted, "payload" in kinds):
                        rows.append(columns | {"payload": payload})
                        size += 200 + len(payload or b"")
                        if size >= BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.limit, self.level = options["path"], int(options.get("file_bytes", FILE_BYTES)), int(options.get("level", 1))
        self.zipped, self.overwrite, self.job = options.get("compression", "gzip") != "none", overwrite, uuid.uuid4().hex

    def _temporary(self, base: str) -> str:
        return f"{base.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator):
        files, base = open_fs(self.path)
        files.create_dir(self._temporary(base), recursive=True)
        made, out, size, own = [], None, 0, uuid.uuid4().hex
        pack = (lambda r: member(r, self.level)) if self.zipped else (lambda r: r)
        try:
            for batch in iterator:
                names = [c for c in batch.schema.names if c in HEADERS]
                rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
                for values, payload in zip(rows, batch.column("payload"), strict=True):
                    if out is None or size >= self.limit:
                        if out is not None:
                            out.close()
                        made.append(f"{own}-{len(made):05d}.warc" + ".gz" * self.zipped)
                        out, size = files.open_output_stream(f"{self._temporary(base)}/{made[-1]}", compression=None), 0
                        out.write(pack(encode({"record_type": "warcinfo", "record_id": f"<urn:file:{made[-1]}>", "date": "1970-01-01T00:00:00Z"}, b"software: palimpsest\r\n")))
                    raw = pack(encode({"date": "1970-01-01T00:00:00Z"} | dict(zip(names, values, strict=True)), payload.as_py()))
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(made)

    def commit(self, messages):
        files, base = open_fs(self.path)
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
                if f.is_file:
                    files.delete_file(f.path)
        files.create_dir(base, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                files.move(f"{self._temporary(base)}/{name}", f"{base.rstrip('/')}/{name}")
        self._clear(files, base)

    def abort(self, messages):
        self._clear(*open_fs(self.path))

    def _clear(self, files, base: str) -> None:
        if files.get_file_info(self._temporary(base)).type != pafs.FileType.NotFound:
            files.delete_dir(self._temporary(base))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Spark push predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, only: dict[str, list[str]] | None = None, pushdown: bool = False, **options) -> DataFrame:
    """The records of archives; leave ``payload`` out of the schema to skip all payloads.

    ``only`` has values of headers (:data:`HEADERS`): no payload of another record is decoded.  With
    ``pushdown`` predicates of the query on headers do that too.  Spark 4.1 keeps those with the loaded table,
    so only a query that filters it in one way may ask for them: of two branches with different
    predicates both would get the last one's records."""
    register(spark)
    if unknown := set(only or {}) - set(HEADERS):
        raise ValueError(f"a record has no {sorted(unknown)}")
    return spark.read.format("warc").schema(schema).options(only=json.dumps(only or {}), pushdown=pushdown, **options).load(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> None:
    """Write a record per page.  Of pages with equal payloads of ``least`` bytes or more the
    one with the largest id is a response and the others revisit it."""
    register(pages.sparkSession)
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    heads = rows.where(F.col("payload_length") >= least).groupBy("digest", "payload_length").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = table(heads.select(F.col("digest").alias("d"), F.col("payload_length").alias("l"), "head"), "payloads")
    same = (F.col("digest") == F.col("d")) & (F.col("payload_length") == F.col("l"))
    if heads.count() <= BROADCAST_DIGESTS:
        found = rows.join(F.broadcast(heads), same, "left")
    else:  # payloads do not meet by digest, which can be hot, but by page
        own = rows.select("id", "digest", "payload_length").join(heads, same).where(~F.col("id").eqNullSafe(F.col("head")))
        own = own.select(F.col("id").alias("i"), F.col("digest").alias("d"), "head").distinct()
        found = rows.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    urn = lambda c: F.concat(F.lit("<urn:row:"), F.url_encode(c.cast("string")), F.lit(">"))
    found.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("head"))).alias("refers_to"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Write archives of pages in the shared folder and read their records back.

    Lengths and digests of responses are taken from the payloads read, those of revisits
    from their headers."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path, id_col, url_col, html_col, least)
    got = read(spark, path, only={"record_type": ["response", "revisit"]})
    number = lambda c: F.url_decode(F.regexp_extract(c, "^<urn:row:(.*)>$", 1))
    full = F.col("record_type") == "response"
    return got.select(
        number("record_id").try_cast(dict(pages.dtypes)[id_col]).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").try_cast(dict(pages.dtypes)[id_col]).alias("refers_to"),
    )
