"""Pages as WARC archives with an index, and selective reads of them.

Method: index first. Every record's file, offset, length, URL and digest are written beside the archives; a
read selects records from the index, sorts them by place, joins neighbouring byte ranges, and fetches each range at
once. A payload that another record holds is written once; the others are ``revisit`` records.

Archives are ``.warc.gz`` files of one gzip member per record. They are written and read through
``pyarrow.fs``, which picks the file system by the path's scheme. A task attempt writes a file of its
own; only files of attempts whose rows arrived are in the index, so a lost executor leaves at most a stray file.
"""

from __future__ import annotations

import base64
import re
import sys
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_SHARED = 1000  # bytes; smaller payloads are written each time
GAP = 64 << 10  # bytes between two wanted records that are read along rather than skipped
RANGE = 8 << 20  # bytes of a joined range at most, unless a single record is larger
STRETCH = 16 << 20  # bytes of records that a task reads, about
FILE_BYTES = 256 << 20  # a task begins another archive beyond

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """``file:/x`` and ``/x`` as ``file:///x``; others stay."""
    return re.sub(r"^(file:)?/+", "file:///", path) if re.match(r"^(file:)?/", path) else path


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _line(text: str) -> str:
    """A header value on one line: control characters and ``%`` as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unline(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def _urn(page_id, digest: str) -> str:
    """A record's id: of pages with equal ids, each payload is one of its own."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def _record(page_id, url, html, digest, size, refers_to, date) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (html or "").encode() if refers_to is None else http
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        lines.insert(3, ("WARC-Target-URI", _line(url)))
    if refers_to is not None:
        lines.insert(3, ("WARC-Refers-To", _urn(refers_to, digest)))
        lines.insert(3, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return _header(lines) + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """A record's fields: headers by name, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines)
    fields["block"] = rest[: int(fields["Content-Length"])]
    return fields


def with_originals(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): refers_to is the largest page_id with an equal payload, null for that page itself.

    Payloads are known by length and SHA-1. The digests are counted before the shuffle, and only those that occur twice
    are joined to the pages; a payload that a third of them share is split by the adaptive skewed join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload).cast("long"))
    shared = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = rows.join(shared, ["digest", "size"], "left")
    return found.withColumn("refers_to", F.when(F.col("page_id") < F.col("_best"), F.col("_best"))).drop("_best")


def write_archives(pages: DataFrame, path: str, date: datetime | None = None) -> DataFrame:
    """Write archives below ``path`` and return the index as a table that is written at ``path/index``.

    ``date`` is when the pages were fetched (with a time zone), the same in every record; by default, when this function was called.
    ``pages`` has page_id, url and html; other columns are not read. Null html: empty payload. Null url: no target
    in the record. Null ids are smaller than all others and never revisited; of rows that repeat the largest id each is a response.
    """
    spark = pages.sparkSession
    folder = _uri(path)
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # read once: a task that runs again writes the same

    def written(batches):
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        task = TaskContext.get()
        stream, name, at = None, None, 0
        try:
            for batch in batches:
                rows = {c: [] for c in ("page_id", "url", "digest", "record_type", "file", "offset", "length")}
                for row in batch.to_pylist():
                    if stream is None or at >= FILE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, at = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        stream = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                    record = _record(row["page_id"], row["url"], row["html"], row["digest"], row["size"], row["refers_to"], stamp)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # one gzip member
                    data = packer.compress(record) + packer.flush()
                    stream.write(data)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    for c, v in zip(rows, (row["page_id"], row["url"], row["digest"], kind, name, at, len(data))):
                        rows[c].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if stream is not None:
                stream.close()

    rows = with_originals(pages).select("page_id", "url", "html", "digest", "size", "refers_to")
    rows.mapInArrow(written, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(selected: DataFrame, path: str, gap: int = GAP) -> DataFrame:
    """The records of ``selected`` index rows, read in byte ranges joined over gaps of up to ``gap`` bytes.

    Payload, payload_bytes and payload_digest are those of the record; for a revisit payload is null and the others
    are the full payload's. A response whose payload doesn't have its digest is an error.
    """
    folder = _uri(path)

    def read(batches):
        import hashlib

        filesystem, root = _filesystem(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        )

        def number(urn):
            text = urn.split(":")[2]
            return None if text == "none" else int(text)

        name = source = None
        for batch in batches:
            places = batch.select(["file", "offset", "length"]).to_pylist()
            out = []
            first = 0
            while first < len(places):
                start, end, last = places[first]["offset"], places[first]["offset"] + places[first]["length"], first + 1
                while last < len(places):
                    p = places[last]
                    if p["file"] != places[first]["file"] or p["offset"] > end + gap or p["offset"] + p["length"] - start > RANGE:
                        break
                    end, last = max(end, p["offset"] + p["length"]), last + 1
                if places[first]["file"] != name:
                    if source is not None:
                        source.close()
                    name = places[first]["file"]
                    source = filesystem.open_input_file(f"{root}/{name}")
                data = source.read_at(end - start, start)
                for p in places[first:last]:
                    fields = parse(zlib.decompress(data[p["offset"] - start : p["offset"] - start + p["length"]], 31))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size, payload, refers = int(fields["X-Payload-Length"]), None, None
                    if fields["WARC-Type"] == "response":
                        payload = fields["block"].partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {name} differs from its digest")
                    else:
                        refers = number(fields["WARC-Refers-To"])
                    url = fields.get("WARC-Target-URI")
                    out.append((number(fields["WARC-Record-ID"]), None if url is None else _unline(url), fields["WARC-Type"], payload, size, digest, refers))
                first = last
                if sum(len(r[3] or b"") for r in out) > RANGE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if source is not None:
            source.close()

    placed = selected.select("file", "offset", "length")
    # neighbours come to one task in order; a stretch of a file, not a whole one, is what is dealt out, to as many tasks as the bytes ask for
    wanted = placed.agg(F.sum("length").alias("n")).first()["n"] or 0
    stretch = F.floor(F.col("offset") / STRETCH)
    return placed.repartition(max(1, -(-wanted // STRETCH)), "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)
