"""WARC archives as a Python data source of Spark, and page archives in which repeated payloads are written once.

Reading. ``spark.read.format("warc").load(folder)``, or ``read`` below. Files (plain, or gzipped in members) are packed into partitions of about ``split`` bytes, or their share of ``cores`` if that is less, whole files each; the writer
starts a new file at ``roll`` bytes. Predicates on the record type and the other columns that stand in a record's header (equality, sets, comparisons, prefixes, null tests) are
pushed into the reader: a record's header is parsed first, and a record that fails them is passed over. So is the payload of a record where ``payload`` is no column asked for. Passing over is
a seek where the file is plain or the gzip member says how long it is (extra field ``sl``, which the writer sets); elsewhere bytes are inflated in pieces and dropped, and never become a row. A
record is held at a time, and rows go out in batches of about 8 MB.

Writing. ``df.write.format("warc").mode("append").save(folder)``: each task writes files under names of its own, and the commit writes one list of the files of tasks that ended well. A reader
of such a folder reads listed files only, so what a lost task left is never seen.

Records. ``records`` turns pages into responses and revisits: of equal payloads of at least ``least`` bytes the one with the largest key is a response, others refer to it. Equality is
that of SHA-256 and length. Revisits hold the HTTP header, whose Content-Length is that of the whole payload, and its SHA-1; no payload.

Defined results: a null text is an empty payload; a null key writes and reads as null, stands for no response of others, and revisits one if there is one; rows that share the largest key and the payload are all responses; a null
address is left out; control characters in a header value are written as %XX; columns beyond those asked for are ignored; an empty table is a folder without records.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass


import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formbook.session import checkpointed

# Columns of a record and, for those in the record's header, the names of the fields.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "content_length": "Content-Length",
}
SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, "
    "content_length long, headers map<string,string>, http_status int, http_length long, payload binary"
)
_BLOCK = {"http_status", "http_length", "payload"}  # columns behind the header
_PIECE = 1 << 16
_HEADER = 1 << 20  # a header longer than this is no record
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Bytes:
    """The plain bytes of an archive, read forward. ``offset`` is where the current member (or record) starts in the file."""

    def __init__(self, raw):
        self.raw, self.raw_at, self.pending, self.out = raw, 0, b"", b""
        self.at = 0  # plain bytes taken from this member
        self.member = self.inflate = None
        self._more()
        self.gzipped = self.pending[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        data = self.raw.read(_PIECE)
        self.raw_at += len(data)
        self.pending += data
        return bool(data)

    @property
    def offset(self) -> int:
        if not self.gzipped:
            return self.raw_at - len(self.pending) - len(self.out)
        return self.member[0] if self.out else self.raw_at - len(self.pending)

    def _begin(self) -> bool:
        """Starts the next member."""
        while len(self.pending) < 12 and self._more():
            pass
        if not self.pending:
            return False
        start, length = self.raw_at - len(self.pending), None
        if self.pending[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {start}")
        if len(self.pending) >= 12 and self.pending[3] & 4:
            size = struct.unpack_from("<H", self.pending, 10)[0]
            while len(self.pending) < 12 + size and self._more():
                pass
            extra = self.pending[12 : 12 + size]
            while len(extra) >= 4:
                n = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and n == 8:
                    length = struct.unpack_from("<II", extra, 4)
                extra = extra[4 + n :]
        self.member, self.inflate, self.at = (start, length), zlib.decompressobj(31), -len(self.out)
        return True

    def _fill(self) -> bool:
        """More plain bytes, a piece at a time; False at the end of the file."""
        if not self.gzipped:
            if not self.pending and not self._more():
                return False
            self.out, self.pending = self.out + self.pending, b""
            return True
        while True:
            if self.inflate is None and not self._begin():
                return False
            more = bool(self.pending) or self._more()
            got = self.inflate.decompress(self.pending, _PIECE)  # without more input there may be output left
            ended = self.inflate.eof
            if not (more or got or ended):
                raise ValueError(f"a gzip member is cut short at {self.raw_at}")
            self.pending = self.inflate.unused_data if ended else self.inflate.unconsumed_tail
            if ended:
                self.inflate = None
            if got:
                self.out += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (found := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if seen > _HEADER:
                raise ValueError(f"no header at {self.offset}")
            if not self._fill():
                if self.out.strip():
                    raise ValueError("the file ends within a header")
                return None
        return self.read(found + len(mark))

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.out and not self._fill():
                raise ValueError("the file ends within a record")
            part, self.out = self.out[:left], self.out[left:]
            parts.append(part)
            left -= len(part)
        self.at += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Passes over ``n`` bytes, with a seek where that is possible."""
        if n <= len(self.out):
            self.read(n)
            return
        if not self.gzipped:
            behind = n - len(self.out) - len(self.pending)
            if behind > 0:
                self.out = self.pending = b""
                self.raw_at += behind
                self.raw.seek(self.raw_at)
                return
        elif self.inflate is not None and self.member[1] is not None and self.at + n == self.member[1][1]:
            self.raw_at = self.member[0] + self.member[1][0]
            self.raw.seek(self.raw_at)
            self.out, self.pending, self.inflate = b"", b"", None
            return
        while n:
            n -= len(self.read(min(n, _PIECE)))


def _headers(head: bytes) -> dict[str, str]:
    """Names and values of a header; a line that starts with a space goes on with the value before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip()
            out[name] = value.strip()
    return out


def _hex(digest: str | None) -> str | None:
    """A SHA-1 as lower-case hex, others as written."""
    if digest is None or not digest.lower().startswith("sha1:"):
        return digest
    said = digest[5:]
    try:
        return base64.b32decode(said.upper()).hex() if len(said) == 32 else bytes.fromhex(said).hex()
    except ValueError:
        return digest


def _passes(test: tuple, row: dict) -> bool:
    """SQL's answer to a pushed test, null counting as false."""
    kind, column, value = test
    have = row[column]
    if kind in ("IsNull", "IsNotNull"):
        return (have is None) == (kind == "IsNull")
    if kind == "EqualNullSafe":
        return have == value
    if have is None or value is None:
        return False
    if kind == "In":
        return have in value
    if isinstance(have, str):
        have, value = have.encode(), value.encode()  # strings compare by bytes
    return {
        "EqualTo": lambda: have == value, "GreaterThan": lambda: have > value, "GreaterThanOrEqual": lambda: have >= value, "LessThan": lambda: have < value,
        "LessThanOrEqual": lambda: have <= value, "StringStartsWith": lambda: have.startswith(value), "StringEndsWith": lambda: have.endswith(value), "StringContains": lambda: value in have,
    }[kind]()


def scan(raw, file: str, columns: Sequence[str], tests: Sequence[tuple]) -> Iterator[dict]:
    """Records of one archive that pass ``tests``, with ``columns``."""
    source = Bytes(raw)
    block = bool(_BLOCK & set(columns))
    while True:
        while source.out[:2] == b"\r\n" or (not source.out and source._fill()):
            if source.out[:2] != b"\r\n":
                break
            source.read(2)
        offset = source.offset
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset} of {file}")
        headers = _headers(head)
        found = {name.lower(): value for name, value in headers.items()}
        row: dict = {c: found.get(f.lower()) for c, f in FIELDS.items()}
        size = int(row["content_length"] or 0)
        row.update(file=file, offset=offset, headers=headers, content_length=size, payload_digest=_hex(row["payload_digest"]))
        if not all(_passes(t, row) for t in tests):
            source.skip(size + 4)
            continue
        row.update(http_status=None, http_length=None, payload=None)
        left = size
        if block and (row["content_type"] or "").replace(" ", "").lower().startswith("application/http") and size:
            http = source.until(b"\r\n\r\n")
            left -= len(http)
            first = http.split(b"\r\n", 1)[0].split(b" ")
            row["http_status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            said = {k.lower(): v for k, v in _headers(http).items()}.get("content-length", "")
            row["http_length"] = int(said) if said.isdigit() else None
        if "payload" in columns and row["record_type"] != "revisit":
            row["payload"] = source.read(left)
            left = 0
        source.skip(left + 4)
        yield row


@dataclass
class Files(ds.InputPartition):
    files: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.split, self.least, self.cores = (int(options.get(n, v)) for n, v in (("split", 128 << 20), ("least", 1 << 20), ("cores", 1)))
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            kind, column = type(f).__name__, f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            known = ("EqualTo", "EqualNullSafe", "In", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "IsNull", "IsNotNull", "StringStartsWith", "StringEndsWith", "StringContains")
            if column in FIELDS and kind in known:
                self.tests.append((kind, column, tuple(f.value) if kind == "In" else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        system, root = _place(self.path)
        files = listed(system, root)
        # as Spark's own readers do: no more in a partition than its share of the cores
        split = min(self.split, max(self.least, sum(size for _, size in files) // self.cores))
        parts: list[list[str]] = []
        held = split
        for name, size in files:
            if held + size > split:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition):
        system, _ = _place(self.path)
        columns = self.schema.names
        target = pa.schema([_arrow(c) for c in columns])
        rows: list[dict] = []
        size = 0
        for name in partition.files:
            with system.open_input_file(name) as raw:
                for row in scan(raw, name, columns, self.tests):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows, columns, target)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, columns, target)


def _arrow(column: str) -> pa.Field:
    kinds = {"offset": pa.int64(), "content_length": pa.int64(), "http_status": pa.int32(), "http_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
    return pa.field(column, kinds.get(column, pa.string()))


def _batch(rows: list[dict], columns: Sequence[str], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "headers" else r[c] for r in rows], target.field(c).type) for c in columns], schema=target)


def listed(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Archives of a folder (or one file) with their sizes. Where commits left lists, only what they name."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
    lists = [f.path for f in found if f.base_name.startswith("_committed-")]
    names = None
    if lists:
        names = set()
        for path in lists:
            with system.open_input_stream(path) as raw:
                names.update(json.loads(raw.read()))
    kept = [(f.path, f.size) for f in found if f.base_name[0] not in "._" and (names is None or f.base_name in names)]
    return sorted(kept)


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def member(plain: bytes, level: int = 6) -> bytes:
    """One gzip member that says how long it is, packed and plain."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    if size >> 32 or len(plain) >> 32:
        return b"\x1f\x8b\x08\0" + b"\0" * 5 + b"\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain)) + body + tail


def record(row: dict) -> bytes:
    """The bytes of a record. ``row`` has columns of ``records``."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    lines = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("date") or DATE)]
    if row.get("target_uri") is not None:
        lines.append(("WARC-Target-URI", row["target_uri"]))
    if row.get("payload_digest") is not None:
        lines.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
    if kind == "revisit":
        lines += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE)]
    block = payload
    if kind in ("response", "revisit"):
        length = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        block = http if kind == "revisit" else http + payload
        lines.append(("Content-Type", "application/http;msgtype=response"))
    else:
        lines.append(("Content-Type", row.get("content_type") or "application/octet-stream"))
    lines.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{n}: {_clean(v)}\r\n" for n, v in lines) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll, self.level = options["path"], int(options.get("roll", 256 << 20)), int(options.get("level", 6))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = batch.schema.names
            for i in range(batch.num_rows):
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    about = {"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
                    size += out.write(member(record(about), self.level))
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(columns)}
                size += out.write(member(record(row), self.level))
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with system.open_output_stream(f"{root}/_committed-{self.job}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages):
        """Nothing to do: without a list no reader sees the files."""


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended to: write to a new folder")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Records of the archives under ``path``; only ``columns`` are parsed, and payloads only if they are among them."""
    register(spark)
    kinds = dict(part.strip().split(" ", 1) for part in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in (columns or kinds))
    options = {"cores": spark.sparkContext.defaultParallelism, **options}
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def write(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode("append").save(path)


def page_id(column: str) -> Column:
    """The whole number in the name of a page's record; null where it had none."""
    said = F.regexp_extract(column, "^<urn:page:(.*)>$", 1)
    return F.when(said != "", said.cast("long"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """record_type, record_id, target_uri, refers_to, payload, payload_bytes, payload_digest: what ``write`` takes, a row per page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "_same": F.unhex(F.sha2("payload", 256))})
    again = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("_same").alias("_s"), F.col("payload_bytes").alias("_b")).agg(F.max("_key").alias("_first"), F.count("*").alias("_n"))
    again = checkpointed(again.where((F.col("_n") > 1) & F.col("_first").isNotNull()).drop("_n"))
    # both sides are plain shuffles, so that adaptive execution can split a payload that many pages share
    joined = rows.join(again, (F.col("_same") == F.col("_s")) & (F.col("payload_bytes") == F.col("_b")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))

    def named(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), named("_key").alias("record_id"), "target_uri", F.when(revisit, named("_first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", F.sha1("payload").alias("payload_digest"),
    )
