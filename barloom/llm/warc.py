"""WARC records in seekable Zstandard bundles: writing, an index of records, reading."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import Members, discard, in_batches, saved
from barloom.session import shared_path

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record bytes after which a frame is closed.
FRAME_BYTES = 1 << 20
#: Frames that one reading task takes.
FRAMES_PER_TASK = 8


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _safe(url: str | None) -> str:
    """A target without blanks and control characters, which would break the header."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "urn:none"


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit without its payload, whose HTTP header still tells its size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _safe(url)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if refers_to is None:
        return _record(headers, http + payload)
    headers += [
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", record_id(refers_to)),
        ("X-Refers-To-Page-Id", str(refers_to)),
    ]
    return _record(headers, http)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; all of ``data`` must be records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")
        yield headers, data[start:stop]
        at = stop + 4


class BundleWriter:
    """Independent frames of whole records, then a skippable frame with the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.held = 0
        self.table: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame's content, length) of the record."""
        if self.held and self.held + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.table), self.held, len(record)
        self.pending.append(record)
        self.held += len(record)
        return place

    def _flush(self) -> None:
        if self.held:
            frame = self.packer.compress(b"".join(self.pending))
            self.sink.write(frame)
            self.table.append((len(frame), self.held))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Frames of a bundle by number, each read and unpacked alone."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        source.seek(size - 9 - 8 * n)
        table = np.frombuffer(source.read(8 * n), "<u4").reshape(-1, 2).astype(np.int64)
        self.sizes = table
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, number: int) -> bytes:
        self.source.seek(int(self.starts[number]))
        return self.unpacker.decompress(self.source.read(int(self.sizes[number, 0])), int(self.sizes[number, 1]))

    def record(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return next(records(self.frame(frame)[offset : offset + length]))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _qualified(spark, folder: str) -> str:
    """The folder with the scheme that Spark would read it by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


INDEX = "page_id long, record_id string, bundle string, frame long, offset long, length long"


def _writes(folder: str, date: str, frame_bytes: int):
    """For ``mapInArrow``: a bundle per partition that has rows. Each attempt writes a file
    of its own name; only those of attempts that succeeded are named in the index."""

    def run(batches):
        from pyspark import TaskContext

        store, root = _store(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        sink = bundle = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if bundle is None:
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    bundle = BundleWriter(sink, frame_bytes)
                    bundle.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                ids = batch.column("page_id").to_pylist()
                places = [
                    bundle.add(page_record(page, url, (html or "").encode(), refers, date))
                    for page, url, html, refers in zip(
                        ids, batch.column("url").to_pylist(), batch.column("html").to_pylist(), batch.column("refers_to").to_pylist()
                    )
                ]
                frame, offset, length = (pa.array(c, pa.int64()) for c in zip(*places))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), pa.array(map(record_id, ids), pa.string()), pa.array([name] * len(ids)), frame, offset, length],
                    ["page_id", "record_id", "bundle", "frame", "offset", "length"],
                )
            if bundle is not None:
                bundle.close()
        finally:
            if sink is not None:
                sink.close()

    return run


def payload_key():
    """Both digests of a payload: payloads made to share one of them do not share the other."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return F.concat(F.unhex(F.sha1(raw)), F.unhex(F.sha2(raw, 256)))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload the page ``refers_to`` also has. ``sha`` is
    that of ``payload_key``."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = saved(pages.select("page_id", payload_key().alias("sha"), F.octet_length(raw).alias("size")), "payloads")
    groups = saved(
        rows.where(F.col("size") >= least_bytes).groupBy("sha", "size")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1").select("sha", "size", "refers_to"),
        "payload-groups",
    )
    met = rows.join(groups, ["sha", "size"]).where("not page_id <=> refers_to and refers_to is not null")
    again = saved(met.select("page_id", "sha", "refers_to").distinct(), "revisits")
    discard(rows)
    discard(groups)
    return again


def write_archive(
    pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
) -> tuple[str, DataFrame]:
    """Archives of ``pages`` (page_id, url, html) in ``folder``, and the index of records:
    (page_id, record_id, bundle, frame, offset, length), the offset within the frame's content.

    Of pages with equal payloads of ``least_bytes`` or more, that with the smallest page_id
    is a response with the payload; the others are revisits of it. Bytes are compared by
    SHA-1, the standard's own measure, SHA-256 and size. Null html is an empty payload. If rows repeat
    the smallest page_id, each is a response; pages without an id refer to one that has one,
    or are responses. Only pages that may be revisits are shuffled with their html. ``folder``
    must be open to all executors (a shared mount, or a store that pyarrow knows); it is made
    under the shared folder of the session if not given. No pages, no bundles.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder or shared_path(spark, "warc"))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    again = revisits(base, least_bytes)
    keyed = base.withColumn("own", payload_key())
    marked = Members(again, F.xxhash64("page_id", "sha")).mark(keyed, F.xxhash64("page_id", "own"), "maybe")
    theirs = again.select(F.col("page_id").alias("their"), "sha", "refers_to")
    told = (
        marked.where("maybe")
        .join(theirs, F.col("page_id").eqNullSafe(F.col("their")) & (F.col("own") == F.col("sha")), "left")
        .select("page_id", "url", "html", "refers_to")
        .union(marked.where("not maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))
    )
    index = saved(in_batches(told).mapInArrow(_writes(folder, date, frame_bytes), INDEX), "warc-index")
    discard(again)
    return folder, index


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _reads(folder: str):
    """For ``mapInArrow``: (bundle, frame, places) to what the records at those places say."""

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            wanted = sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"]))
            opened, reader, source = None, None, None
            for place in wanted:
                if place["bundle"] != opened:
                    if source is not None:
                        source.close()
                    opened, source = place["bundle"], store.open_input_file(f"{root}/{place['bundle']}")
                    reader = BundleReader(source)
                data = reader.frame(place["frame"])
                rows = [_told(*_record_at(data, p["offset"], p["length"], p["record_id"])) for p in place["places"]]
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in READ.split(", ")]
                )
            if source is not None:
                source.close()

    return run


def _record_at(frame: bytes, offset: int, length: int, known: str) -> tuple[dict[str, str], bytes]:
    """The record that the index names: one whole record with its identifier lies there, or it fails."""
    found = list(records(frame[offset : offset + length]))
    if len(found) != 1 or found[0][0]["WARC-Record-ID"] != known:
        raise ValueError(f"the index does not lead to {known}")
    return found[0]


def _told(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    return page and int(page), size, digest, headers["WARC-Type"], refers and int(refers), headers["WARC-Target-URI"]


def read_archive(folder: str, index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record that
    ``index`` names, each read from its own place in its frame; frames are dealt out to tasks, and the
    places of a frame are as many as fit into it. A place that does not hold the record with that
    identifier fails. Payloads of responses are hashed again and must match; a revisit tells those of the
    full payload."""
    place = F.struct("offset", "length", "record_id")
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(place)).alias("places"))
    tasks = max(1, -(-index.select("bundle", "frame").distinct().count() // FRAMES_PER_TASK))
    return frames.repartition(tasks, "bundle", "frame").mapInArrow(_reads(folder), READ)
