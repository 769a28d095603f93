"""WARC archives: deduplicating writer and splittable reader.

Writer: one gzip member per record.  Of the records whose payloads are equal
(SHA-1) the one with the smallest id is a ``response``; the others become
``revisit`` records without payload.  Each task writes one archive and returns
a manifest row; only rows of successful attempts reach the manifest, so a file
left by a lost executor is never read.

Reader: archives are cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate only if its first bytes inflate to a WARC header that
parses, and then owns every record whose member starts inside the range (it
reads past the end of the range to finish the last one).

Defined cases: a null payload is an empty one; a null id is kept as null and
counts as the largest; every row gets a record with its own URI and a record id
of its own (the id's later rows, in the order of URI and digest, carry a copy
number); of several rows with the smallest id of a payload the one with the
smallest URI is the response and the others are revisits; a payload shorter
than ``min_bytes`` is always a response; an empty table gives an empty archive
set; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

MAGIC = b"\x1f\x8b\x08"
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LAST = (1 << 63) - 1

MANIFEST = "path string, n_records long, n_bytes long"
RECORD = (
    "id long, record_id string, record_type string, uri string, refers_to long, payload_bytes long, "
    "payload_digest string, digest_ok boolean, payload binary, path string, offset long"
)


def open_fs(uri: str):
    """(file system, path) of a URI; plain paths are local ones."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


PLAN = ("id", "uri", "payload", "digest", "n_bytes", "record_type", "refers_to", "copy")


def plan_records(pages: DataFrame, id_col="page_id", uri_col="url", payload_col="html", min_bytes: int = 0) -> DataFrame:
    """id, uri, payload (null for revisits), digest (hex), n_bytes, record_type, refers_to, copy.

    Only one payload of each group of equal ones is shuffled (partial
    aggregation keeps the smallest id on the map side); revisits travel
    without payload.  copy tells a row's record apart from others of its id and
    payload.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long"), "ord": F.coalesce("id", F.lit(_LAST))})
    no_ref, first_copy = F.lit(None).cast("long").alias("refers_to"), F.lit("").alias("copy")
    big = p.filter(F.col("n_bytes") >= min_bytes) if min_bytes > 0 else p
    order = F.struct("ord", F.col("uri").isNotNull().alias("named"), F.coalesce("uri", F.lit("")).alias("uri"))
    first = big.groupBy("digest").agg(F.min_by(F.struct("id", "uri", "payload", "n_bytes"), order).alias("r"))
    responses = first.select("r.id", "r.uri", "r.payload", "digest", "r.n_bytes", F.lit("response").alias("record_type"), no_ref, first_copy)
    light = materialize(big.select("id", "uri", "digest", "n_bytes", "ord"), "warc-rows")
    # Both sides of the join are written tables: adaptive execution can split a hot digest.
    ids = materialize(light.groupBy("digest").agg(F.min(order).alias("first")), "warc-first")
    rows = materialize(light.groupBy("digest", "ord", "n_bytes", "uri").agg(F.count("*").alias("c"), F.first("id").alias("id")), "warc-distinct")
    is_first = (F.col("ord") == F.col("first.ord")) & (F.col("uri").isNotNull() == F.col("first.named")) & (F.coalesce("uri", F.lit("")) == F.col("first.uri"))
    left = rows.join(ids, "digest").withColumn("c", F.col("c") - is_first.cast("long")).filter("c > 0")
    revisits = left.select(
        "id", "uri", F.lit(None).cast("binary").alias("payload"), "digest", "n_bytes", F.lit("revisit").alias("record_type"),
        F.nullif("first.ord", F.lit(_LAST)).alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("n"),
    ).withColumn("copy", F.concat_ws(".", F.lit("r"), F.hex(F.xxhash64("uri")), "n")).drop("n")
    out = responses.unionByName(revisits)
    if min_bytes > 0:
        small = p.filter(F.col("n_bytes") < min_bytes).select("id", "uri", "payload", "digest", "n_bytes", F.lit("response").alias("record_type"), no_ref, F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")).alias("copy"))
        out = out.unionByName(small)
    return out


def _uri_text(uri: str | None) -> str | None:
    """A header value can't hold control characters; they are percent-encoded."""
    return None if uri is None else "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def _urn(i: int | None, digest: str, copy: str = "") -> str:
    """Record id: of a payload's response without copy, of other records with one of their own."""
    return f"<urn:page:{'' if i is None else i}:{digest}{':' * bool(copy)}{copy}>"


def encode_record(rid, uri, payload: bytes, digest_hex: str, n_bytes: int, kind: str, refers_to, copy: str = "") -> bytes:
    """One gzip member."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(rid, digest, copy)}", f"WARC-Date: {EPOCH}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_uri_text(uri)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write_archives(records: DataFrame, out_dir: str) -> DataFrame:
    """Write plan_records() rows as archives under out_dir; the manifest, materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out_dir)
        name, out, n, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            cols = [b.column(i) for i in range(len(PLAN))]
            for i in range(b.num_rows):
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                rid, uri, payload, digest, n_bytes, kind, ref, copy = (c[i].as_py() for c in cols)
                data = encode_record(rid, uri, payload or b"", digest, n_bytes, kind, ref, copy)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out_dir}/{name}"], "n_records": [n], "n_bytes": [size]})

    cols = records.select(*PLAN)
    return materialize(cols.mapInArrow(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file from some place on, read block by block; at: the place of buf[pos]."""

    def __init__(self, f, size: int, at: int, block: int = 1 << 20):
        self.f, self.left, self.at, self.block, self.buf, self.pos = f, size - at, at, block, b"", 0
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(min(self.block, self.left)) if self.left > 0 else b""
        self.left -= len(got)
        self.buf, self.pos = self.buf[self.pos :] + got, 0
        return bool(got)

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n


def _member(w: _Window, step: int = 1 << 14) -> bytes | None:
    """Inflate the member at w.at and move behind it; None (w unmoved) if it is no record.

    The first inflated bytes decide: anything but a WARC version line is a
    chance find of the magic inside compressed data.
    """
    d, out, used, head = zlib.decompressobj(31), [], 0, b""
    try:
        while not d.eof:
            if w.pos + used == len(w.buf) and not w.more():
                return None
            chunk = w.buf[w.pos + used : w.pos + used + step]
            used += len(chunk)
            got = d.decompress(chunk)
            if len(head) < 7:
                head = (head + got)[:7]
                if not b"WARC/1.".startswith(head):
                    return None
            out.append(got)
    except zlib.error:
        return None
    data = b"".join(out)
    end = data.find(b"\r\n\r\n")
    length = next((int(x[15:]) for x in data[: max(end, 0)].split(b"\r\n") if x[:15].lower() == b"content-length:" and x[15:].strip().isdigit()), None)
    if end < 0 or length is None or len(data) != end + 4 + length + 4:
        return None
    w.skip(used - len(d.unused_data))
    return data


def read_range(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record whose member starts in [start, end)."""
    w = _Window(f, size, start)
    while w.at < end:
        found = w.buf.find(MAGIC, w.pos)
        if found < 0:
            w.skip(max(0, len(w.buf) - w.pos - 2))
            if not w.more():
                return
            continue
        w.skip(found - w.pos)
        if w.at >= end:
            return
        here = w.at
        data = _member(w)
        if data is None:
            w.skip(1)
        else:
            yield here, data


def parse_record(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode().lower()] = v.strip().decode()
    block = block[: int(fields["content-length"])]
    kind = fields.get("warc-type", "")
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]

    def page(v: str | None) -> int | None:
        own = v[10:-1].partition(":")[0] if v and v.startswith("<urn:page:") else ""
        return int(own) if own else None

    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        n, digest = int(fields.get("x-payload-length", "-1")), told
    else:
        n, digest = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
    return {
        "id": page(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"), "refers_to": page(fields.get("warc-refers-to")),
        "payload_bytes": n, "payload_digest": digest, "digest_ok": not told or told == digest, "payload": block if kind != "revisit" else None,
    }


def read_archives(manifest: DataFrame, split_bytes: int = 32 << 20, with_payload: bool = True, most_tasks: int = 200_000) -> DataFrame:
    """Records of the archives that manifest (path, n_bytes) lists, read by byte range."""
    # A stated number of partitions, about one for each range: the rows are tiny,
    # and adaptive execution would otherwise gather all of them into one task.
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("n_bytes") / split_bytes)), F.lit(0))).first()[0]
    ranges = manifest.select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")
    ).repartition(max(1, min(int(n), most_tasks)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())]
        )
        for b in batches:
            for x in b.to_pylist():
                fs, place = open_fs(x["path"])
                rows, held = [], 0
                with fs.open_input_file(place) as f:
                    for offset, data in read_range(f, x["n_bytes"], x["start"], min(x["start"] + split_bytes, x["n_bytes"])):
                        r = parse_record(data) | {"path": x["path"], "offset": offset}
                        if not with_payload:
                            r["payload"] = None
                        held += len(data) if with_payload else 400
                        rows.append(r)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, out_dir: str | None = None, min_bytes: int = 0, **cols) -> DataFrame:
    """Write pages as archives, then read the archives back."""
    out = out_dir or new_path(spark, "warc")
    return read_archives(write_archives(plan_records(pages, min_bytes=min_bytes, **cols), out), with_payload=False)
