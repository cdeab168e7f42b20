"""Legacy archive converter: ARC records, by version-specific header lines and declared lengths, into equivalent WARC records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, qualified, saved, tune, work_dir

#: Fields of an ARC record's header line, by the version that the file's first record declares.
ARC_FIELDS = {
    b"1": ("url", "ip", "date", "mime", "length"),
    b"2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100

_RECORD = "key long, url string, ip string, archive_date string, mime string, arc_version int, http binary, payload binary, payload_bytes long, payload_digest string"


def arc_blocks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20000101000000", version: int = 1) -> DataFrame:
    """Pages as one-record ARC files: key, arc (binary). White space in a url is percent-encoded; a null url is `-`, a null html is empty.

    Repeated rows are archives of their own, very long pages are one record each, an empty table gives none.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    size = F.octet_length(http) + F.octet_length(payload)
    address = F.coalesce(F.regexp_replace(url, r"\s", "%20"), F.lit("-"))
    middle = F.lit(f"0.0.0.0 {date} text/html") if version == 1 else F.lit(f"0.0.0.0 {date} text/html 200 - - 0 pages.arc")
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 converter\n{names}\n"
    tail = "" if version == 1 else " 200 - - 0 pages.arc"
    first = f"filedesc://pages.arc 0.0.0.0 {date} text/plain{tail} {len(body)}\n{body}\n"
    return pages.select(F.col(key).cast("long").alias("key"), F.concat(F.lit(first).cast("binary"), F.concat_ws(" ", address, middle, size.cast("string")).cast("binary"), F.lit("\n").cast("binary"), http, payload, F.lit("\n").cast("binary")).alias("arc"))


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, its own description left out. Each ends where its declared length says, whatever its bytes are."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].rstrip(b"\r")
        begin = end + 1
        if fields is None or line.startswith(b"filedesc://"):
            length = int(line.rsplit(b" ", 1)[1])
            declared = data[begin : begin + length].split(b" ", 1)[0]
            if declared not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {declared!r}")
            fields, version = ARC_FIELDS[declared], int(declared)
            at = begin + length
            continue
        # a url may hold spaces; the other fields may not
        values = line.rsplit(b" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields, not {len(fields)}")
        record = dict(zip(fields, values))
        length = int(record["length"])
        body = data[begin : begin + length]
        if len(body) < length:
            raise ValueError("an ARC record is shorter than it declares")
        split = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0
        split = max(split, 0) if split >= 4 else 0
        text = lambda x: x.decode("utf-8", "replace")
        yield {"url": text(record["url"]), "ip": text(record["ip"]), "archive_date": text(record["date"]), "mime": text(record["mime"]), "arc_version": version, "http": body[:split], "payload": body[split:]}
        at = begin + length


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("archive_date", pa.string()), ("mime", pa.string()), ("arc_version", pa.int32()), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    for batch in batches:
        rows, held = [], 0
        for key, arc in zip(batch.column(0).to_pylist(), batch.column(1)):
            for r in parse_arc(arc.as_py() or b""):
                r |= {"key": key, "payload_bytes": len(r["payload"]), "payload_digest": hashlib.sha256(r["payload"]).hexdigest()}
                rows.append(r)
                held += len(r["payload"])
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC files (.arc, or .arc.gz with a member for each record or one for all) as key (null), arc.

    A file is one cell, so it may have 2 GB at most, unzipped too; larger ones are to be cut at a record before. Repeated files are rows of their own; a folder without files gives an empty table.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(path).select(F.lit(None).cast("long").alias("key"), "content")
    return raw.select("key", _unzipped("content").alias("arc"))


@F.arrow_udf(T.BinaryType())
def _unzipped(files: pa.Array) -> pa.Array:
    return pa.array([_members(x.as_py()) if x.is_valid else None for x in files], pa.binary())


def _members(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) if out else data


def convert(arcs: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """ARC files (key, arc) to what their WARC records need: the parsed fields, payload, payload_digest, original.

    original is null for a response, and else the smallest key among the records with an equal payload of at
    least revisit_bytes, which the record revisits. Repeated records with that smallest key are all responses;
    so are records whose payload nobody with a key has. Archives are parsed once: the records are written, and
    originals are decided on their keys, lengths and digests alone. Smallest keys are aggregated before the shuffle,
    and Spark splits the join where many records have one payload. A null archive has no record, an empty payload
    is never revisited, very long ones travel in batches of their own, repeated rows are records of their own, an
    empty table gives none; other columns of arcs are left out.
    """
    tune(arcs.sparkSession)
    records = saved(arcs.select("key", "arc").mapInArrow(_parsed, _RECORD), "arc-records")
    again = records.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.min("key").alias("first__"), F.count("*").alias("n__")).where("n__ > 1 and first__ is not null").select("payload_digest", "first__")
    out = records.join(again, "payload_digest", "left")
    return out.withColumn("original", F.when(~F.col("key").eqNullSafe(F.col("first__")) & (F.col("payload_bytes") >= revisit_bytes), F.col("first__"))).drop("first__")


def _quoted(x: str) -> str:
    return re.sub(r"[\r\n]+", " ", x)


def record_id(key: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {date} {digest} {url}')}>"


def _b32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")


def warc_record(r: dict) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has the HTTP header and no payload."""
    revisit = r["original"] is not None
    block = r["http"] + (b"" if revisit else r["payload"])
    d = r["archive_date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    kind = "revisit" if revisit else "response" if r["http"] else "resource"
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(r["key"], r["url"], r["archive_date"], r["payload_digest"])), ("WARC-Date", date), ("WARC-Target-URI", _quoted(r["url"])), ("WARC-IP-Address", r["ip"]),
        ("WARC-Payload-Digest", f"sha256:{_b32(r['payload_digest'])}"), ("WARC-Block-Digest", f"sha256:{_b32(hashlib.sha256(block).hexdigest())}"),
        ("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"]), ("Content-Length", str(len(block))), ("X-Payload-Length", str(len(r["payload"])))]
    if r["key"] is not None:
        head.append(("X-Source-Key", str(r["key"])))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Source-Key", str(r["original"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _warc_writer(out: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(out)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, stream, n = f"part-{part:06d}.warc.gz", None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                stream = stream or store.open_output_stream(f"{folder}/{name}.{attempt}", compression=None)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                stream.write(c.compress(warc_record({f: batch.column(f)[k].as_py() for f in batch.schema.names})) + c.flush())
                n += 1
        if stream is not None:
            stream.close()
            store.move(f"{folder}/{name}.{attempt}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{out}/{name}"], "n_records": pa.array([n], pa.int64())})

    return write


def write_warc(records: DataFrame, out: str | None = None, level: int = 3) -> DataFrame:
    """Writes what convert() gives as part-N.warc.gz, a member for each record; returns path and n_records of each file. No records, no files."""
    spark = records.sparkSession
    out = qualified(spark, out) if out else work_dir(spark, "warc")
    store, folder = filesystem(out)
    store.create_dir(folder, recursive=True)
    columns = ["key", "url", "ip", "archive_date", "mime", "http", "payload", "payload_digest", "original"]
    return saved(records.select(*columns).mapInArrow(_warc_writer(out, level), "path string, n_records long"), "warc-files")


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return fields, block


def members(stream) -> Iterator[bytes]:
    """The members of a gzip stream, one at a time, read in chunks."""
    d, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        out.append(d.decompress(data))
        data = b""
        if d.eof:
            data = d.unused_data
            yield b"".join(out)
            d, out = zlib.decompressobj(31), []


def _warc_reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as f:
                    for member in members(f):
                        h, block = parse_warc(member)
                        payload = None if h["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else block
                        digest = base64.b32decode((x := h["warc-payload-digest"].partition(":")[2]) + "=" * (-len(x) % 8)).hex()
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a payload does not have its digest in {path}")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        rows.append({"key": number("x-source-key"), "record_type": h["warc-type"], "record_id": h["warc-record-id"], "url": h["warc-target-uri"], "date": h["warc-date"], "payload_bytes": number("x-payload-length"), "payload_digest": digest, "refers_to": number("x-refers-to-source-key")} | ({"payload": payload} if with_payload else {}))
                        held += len(block) if with_payload else 100
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of written files, payloads checked against their digests: key, record_type, record_id, url, date, payload_bytes, payload_digest, refers_to, payload.

    No files give no records; repeated records are rows of their own, and a record is read whole, however long.
    """
    tune(files.sparkSession)
    schema = "key long, record_type string, record_id string, url string, date string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return files.select("path").repartition(max(1, files.count())).mapInArrow(_warc_reader(with_payload), schema)
