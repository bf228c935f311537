"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a footer lists the frames'
sizes in the seekable format (a skippable frame, magic 0x184D2A5E, ending in 0x8F92EAB1),
so plain decoders still read the file. The index maps each record identifier to its frame and
the offset in the frame's data. Of pages with equal payloads the one with the largest page_id
is stored; the others become revisit records without a payload that refer to it.

Defined results: a null html is an empty payload; a null url is left out; line ends in a url
are percent-encoded; pages whose id equals the group's largest are all stored; a null page_id
is smaller than any other, and stored if its group has no other; an empty table gives no rows.
A payload of any length is one record in a frame of its own length at least.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow_schema, materialize, new_path, pieces, read

FRAME_BYTES, LEVEL, MIN_BYTES = 1 << 18, 3, 0
#: Groups of equal payloads up to which their table is broadcast (about 60 bytes each); beyond, the join shuffles.
BROADCAST_GROUPS = 500_000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
INDEX = "record_id string, page_id long, file string, frame int, offset long, length long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records in a frame's data, with where they start and end."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        end = stop + 4 + int(head["Content-Length"])
        block = data[stop + 4 : end]
        cut = block.index(b"\r\n\r\n") + 4
        http = dict(line.split(": ", 1) for line in block[: cut - 4].decode().split("\r\n")[1:])
        yield {"head": head, "http": http, "payload": block[cut:], "offset": at, "length": end + 4 - at}
        at = end + 4


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """frames: (compressed size, size, low 32 bits of the data's XXH64)."""
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    foot = struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot


def read_seek_table(f, size: int) -> list[tuple[int, int, int, int]]:
    """(place, compressed size, size, checksum) of each frame of an open file."""
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    raw, out, at = f.read_at(n * each, size - 9 - n * each), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", raw, k * each)
        out.append((at, packed, plain, struct.unpack_from("<I", raw, k * each + 8)[0] if each == 12 else 0))
        at += packed
    return out


def open_file(path: str):
    from urllib.parse import unquote

    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else unquote(path.replace("file:", "file://", 1)))
    return store, inner


def with_roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with revisit and refers_to. Only digests and ids are shuffled unless groups are very many."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.withColumns({"digest": F.unhex(F.sha1(payload)), "n": F.octet_length(payload)})
    groups = materialize(keyed.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "rep"), "payloads")
    table = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    revisit = F.col("rep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("rep")) & (F.col("n") >= min_bytes)
    return keyed.join(table, "digest", "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("rep")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, level: int = LEVEL, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write one archive per task under ``path``; return the index of the records. An interrupted task's file has no seek table and no rows."""
    rows = with_roles(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), min_bytes)
    kind, out = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        sink, name, frames = None, "", []
        held, waiting, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, size
            data = b"".join(held)
            packed = pack.compress(data)
            sink.write(packed)
            rows = [(r, p, name, len(frames), o, n) for r, p, o, n in waiting]
            frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            held, waiting, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            for part in pieces(batch, 2):
                for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if sink is None:
                        store, folder = open_file(path)
                        store.create_dir(folder, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        sink = store.open_output_stream(f"{folder}/{name}", compression=None)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    made = record(page_id, url, payload, base32(hashlib.sha1(payload).digest()), refers_to, revisit)
                    held.append(made)
                    waiting.append((f"urn:page:{'' if page_id is None else page_id}", page_id, size, len(made)))
                    size += len(made)
                    if size >= frame_bytes:
                        yield flush()
        if sink is not None:
            if held:
                yield flush()
            sink.write(seek_table(frames))
            sink.close()

    return materialize(rows.mapInArrow(run, kind), "warc-index")


def read_archives(spark: SparkSession, path: str, *, files: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """One row per record of the archives under ``path`` (of ``files``, column file, if given), frame by frame."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "length")
    if files is not None:
        found = found.join(files.select("file").distinct(), F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi")
    frame_kind, frame_out = arrow_schema("path string, place long, packed long, plain long, checksum long")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = open_file(name)
                with store.open_input_file(inner) as f:
                    rows = [(name, *x) for x in read_seek_table(f, length)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), frame_out, strict=True)], schema=frame_out)

    kind, out = arrow_schema(RECORDS)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        unpack, last, f = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for name, place, packed, plain, checksum in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last:
                    if f is not None:
                        f.close()
                    store, inner = open_file(name)
                    f, last = store.open_input_file(inner), name
                data = unpack.decompress(f.read_at(packed, place), max_output_size=plain)
                if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                    raise ValueError(f"{name}: the frame at {place} is damaged")
                rows = []
                for r in parse(data):
                    head, revisit = r["head"], r["head"]["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base32(hashlib.sha1(r["payload"]).digest()) != digest:
                        raise ValueError(f"{name}: a payload of the frame at {place} has another digest")
                    page = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    to = head["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">") if revisit else ""
                    rows.append((int(page) if page else None, head.get("WARC-Target-URI"), head["WARC-Type"], int(to) if to else None, int(r["http"]["Content-Length"]) if revisit else len(r["payload"]), digest, r["payload"] if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = found.repartition(parts).mapInArrow(frames, frame_kind)
    return listed.repartition(parts, "path", F.expr("place div 16777216")).sortWithinPartitions("path", "place").mapInArrow(records, kind)


def read_record(path: str, frame: int, offset: int, length: int) -> dict:
    """One record of an archive, by what the index says of it; only its frame is read."""
    import zstandard

    store, inner = open_file(path)
    with store.open_input_file(inner) as f:
        place, packed, plain, _ = read_seek_table(f, store.get_file_info(inner).size)[frame]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, place), max_output_size=plain)
    return next(parse(data[offset : offset + length]))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    index = write_archives(pages, path, **options)
    if index.isEmpty():
        return spark.createDataFrame([], RECORDS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    return read_archives(spark, path, files=index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, url, strlen(body) AS n, sha1(body) AS h FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(h, i, 1))]), 'string_agg', '') AS bits,
  max(page_id) OVER (PARTITION BY h) AS rep FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = rep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = rep THEN NULL ELSE rep END AS refers_to, url
FROM b
"""
