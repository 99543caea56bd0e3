"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding a group of records, and a footer in the public
seekable format: a skippable frame with the compressed and decompressed size of every frame. An index maps a record's
page to its frame and to the record's offset inside the frame, so one record is read by decompressing one frame; reading
all goes by the index too. Bundles are rows of a table; ``export_files`` makes files of them that any reader of
Zstandard and WARC opens.

Of records with equal payloads, that with the largest page id is the response, the others are revisits of it; smaller
payloads than ``min_payload`` are never revisits.

Defined cases: a null text is an empty payload; rows that repeat page id and payload are each written, as responses if
they hold the largest id, with record ids of their own; null page ids sort below all others, and such a record names no
page; an empty table gives no bundle and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import new_path

#: Bytes of records in a frame, and compressed bytes in a bundle, beyond which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
#: Headers of ours: the record's page, and the page of the response that a revisit repeats.
PAGE, REVISITED = "X-Page-ID", "X-Refers-To-Page-ID"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, response_url=None, record_id: str | None = None) -> bytes:
    """A response record, or, with ``refers_to``, a revisit record that holds the HTTP header alone.

    A revisit names the response by its URI and date, as the format has it, and by its page.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = lambda u: "".join(c for c in (u or "") if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id or uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {clean(response_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"{REVISITED}: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the offset behind it; its payload digest is computed anew where a payload is there."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    http = data[start:body].decode()
    length = int(http.split("Content-Length: ", 1)[1].split("\r\n", 1)[0])
    kind, number = head["WARC-Type"], lambda name: int(head[name]) if name in head else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = data[body:stop] if kind == "response" else None
    if payload is not None and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("a payload does not match its digest")
    out = {
        "record_id": head["WARC-Record-ID"],
        "page_id": number(PAGE),
        "url": head["WARC-Target-URI"],
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(REVISITED),
    }
    return out, stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of ``(compressed, decompressed)`` sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """``(offset, compressed, decompressed)`` of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, c, d = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + c], max_output_size=d)


def read_at(bundle: bytes, frame: int, offset: int) -> dict:
    """One record, by its place in the index."""
    return parse_record(read_frame(bundle, frame), offset)[0]


class Bundler:
    """Gathers records and gives out whole bundles with the places of their records."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.clear()

    def clear(self):
        self.open, self.data, self.frames, self.places = bytearray(), bytearray(), [], []

    def close_frame(self):
        if self.open:
            packed = self.pack(bytes(self.open))
            self.frames.append((len(packed), len(self.open)))
            self.data += packed
            self.open = bytearray()

    def add(self, page_id, record: bytes):
        """Returns a finished bundle now and then."""
        self.places.append((page_id, len(self.frames), len(self.open)))
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self.close_frame()
        return self.finish() if len(self.data) >= self.bundle_bytes else None

    def finish(self):
        self.close_frame()
        if not self.frames:
            return None
        out = bytes(self.data + seek_table(self.frames)), self.places
        self.clear()
        return out


BUNDLE_SCHEMA = "bundle_id string, bundle binary, page_ids array<bigint>, frames array<int>, offsets array<int>"


def write_bundles(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0
) -> DataFrame:
    """Write ``pages`` below ``path``: one row per bundle with its record index. Returns the written table.

    Only digests are grouped; each page is then joined with its digest's response id, a join whose hot keys Spark splits.
    """
    pages = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    # Twins alone can be revisits: groups of one are dropped before the join.
    last = (
        pages.groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("one"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", F.col("one.page_id").alias("response"), F.col("one.url").alias("response_url"))
    )
    planned = pages.join(last, "digest", "left").select(
        "page_id", "url", "payload",
        F.when((F.length("payload") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"), "response_url",
    )

    def bundle(batches):
        gather = Bundler()

        def row(done):
            data, places = done
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(data).hexdigest()]),
                    pa.array([data], pa.binary()),
                    pa.array([[p[0] for p in places]], pa.list_(pa.int64())),
                    pa.array([[p[1] for p in places]], pa.list_(pa.int32())),
                    pa.array([[p[2] for p in places]], pa.list_(pa.int32())),
                ],
                names=["bundle_id", "bundle", "page_ids", "frames", "offsets"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to, response_url = (batch.column(k)[i].as_py() for k in range(5))
                if done := gather.add(page_id, record_bytes(page_id, url, payload, digest_of(payload), refers_to, response_url)):
                    yield row(done)
        if done := gather.finish():
            yield row(done)

    # Random bytes do not compress twice.
    planned.mapInArrow(bundle, BUNDLE_SCHEMA).write.option("compression", "none").parquet(path)
    return pages.sparkSession.read.schema(BUNDLE_SCHEMA).parquet(path)


RECORD_SCHEMA = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, by the index; a revisit has no payload but its length and digest."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def parse(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, pages, frames, offsets = (batch.column(c)[k].as_py() for c in range(4))
                spots, at = list(zip(pages, frames, offsets)), 0
                for frame in range(len(read_seek_table(data))):
                    plain, rows = read_frame(data, frame), []
                    while at < len(spots) and spots[at][1] == frame:
                        rec, _ = parse_record(plain, spots[at][2])
                        if rec["page_id"] != spots[at][0]:
                            raise ValueError("the index names another page")
                        if not payloads:
                            rec["payload"] = None
                        rows.append({name: rec[name] for name in schema.names})
                        at += 1
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                if at < len(spots):
                    raise ValueError("the index names a frame that is not there")

    return bundles.select("bundle", "page_ids", "frames", "offsets").mapInArrow(parse, RECORD_SCHEMA)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write every bundle as ``<bundle id>.warc.zst`` into a mounted folder that the executors share.

    Returns ``file, size``. A file appears whole under its name, so a task that is run again does no harm.
    """

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{folder}/{name}.warc.zst"
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data.as_buffer())
                os.replace(f.name, path)
                names.append(path)
                sizes.append(os.path.getsize(path))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "size"])

    return bundles.select("bundle_id", "bundle").mapInArrow(write, "file string, size bigint")


def lookup(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of some ids: the index names the frames, and only those frames are decompressed."""
    wanted = page_ids.select(F.col(page_ids.columns[0]).alias("page_id")).distinct()
    places = (
        bundles.select("bundle_id", F.explode(F.arrays_zip("page_ids", "frames", "offsets")).alias("at"))
        .select("bundle_id", F.col("at.page_ids").alias("page_id"), F.col("at.frames").alias("frame"), F.col("at.offsets").alias("offset"))
        .join(wanted, "page_id", "left_semi")
        .groupBy("bundle_id")
        .agg(F.collect_list(F.struct("frame", "offset")).alias("at"))  # a bundle's size bounds its records
    )

    def fetch(batches):
        for batch in batches:
            rows = [
                read_at(r["bundle"], at["frame"], at["offset"]) for r in batch.to_pylist() for at in r["at"]
            ]
            yield pa.RecordBatch.from_pylist(
                [{k: r[k] for k in ("page_id", "payload", "record_type")} for r in rows],
                schema=pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("record_type", pa.string())]),
            )

    return (
        bundles.select("bundle_id", "bundle")
        .join(places, "bundle_id")
        .mapInArrow(fetch, "page_id bigint, payload binary, record_type string")
    )


def warc_round_trip(pages: DataFrame, min_payload: int = 0, **columns) -> DataFrame:
    """Write the pages to bundles in the shared folder and return the digest rows as read back."""
    bundles = write_bundles(pages, new_path(pages.sparkSession, "warc"), min_payload=min_payload, **columns)
    return read_bundles(bundles, payloads=False).drop("payload", "url")
