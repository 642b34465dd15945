"""WARC archives in Zstandard, written and read in parallel.

An archive opens with a skippable frame that holds the dictionary (itself compressed if
that is smaller); then every record is one frame. The reader walks frame headers and
block headers to find where each frame ends, decodes it alone, and checks the version
line, the needed headers, the block's length and the payload's digest.

Each task trains the dictionary of an archive on the archive's own first records and
starts a new archive past ``archive_bytes``, so memory stays bounded. Files get their
final name by a rename, and names depend on the partition only: a task that runs again
replaces its own files.

Of records with equal payloads (of ``revisit_from`` bytes or more) that with the largest
id is a response and the others are revisits of it. Defined results: null payloads are
empty; a null id is written as an empty one and read back as null; ids that repeat with
equal payloads are all responses where they are the largest. Extra columns are ignored;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import mapped, new_path, slices, written

#: Fixed values of the two formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2025-01-01T00:00:00Z"
_MOST_BROADCAST = 100_000
_URN = "urn:x-record:"


class WarcError(ValueError):
    """A file or record that breaks the format."""


def record_id(key) -> str:
    return f"<{_URN}{'' if key is None else quote(str(key), safe='')}>"


def key_of(value: str) -> str | None:
    if not value.startswith(f"<{_URN}") or not value.endswith(">"):
        raise WarcError(f"foreign record id {value[:80]}")
    return unquote(value[len(_URN) + 1 : -1]) or None


def make_record(key, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", quote(url, safe="!#$%&'()*+,-./:;=?@[]_~"))] if url else []),
        ("WARC-Payload-Digest", digest),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, block and, for responses, the payload; raises WarcError where a rule is broken."""
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not split or lines[0] not in (VERSION, b"WARC/1.0"):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise WarcError("header without a colon")
        headers[name.strip()] = value.strip()
    if missing := [n for n in NEEDED if n not in headers]:
        raise WarcError(f"headers missing: {missing}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the block's length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    fields = dict(line.decode("latin-1").split(": ", 1) for line in http.split(b"\r\n")[1:])
    stated = int(fields["Content-Length"])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    if headers["WARC-Type"] == "response":
        if len(payload) != stated:
            raise WarcError("payload's length differs from the HTTP header")
        if hashlib.sha1(payload).digest() != digest:
            raise WarcError("payload's digest differs")
    elif headers["WARC-Type"] != "revisit" or "WARC-Refers-To" not in headers or payload:
        raise WarcError("neither a response nor a whole revisit")
    return {"headers": headers, "payload": payload, "payload_bytes": stated, "digest": digest.hex()}


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its headers alone."""
    if len(data) < at + 6:
        raise WarcError("cut frame")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        content = (1 if single else 0, 2, 4, 8)[flags >> 6]
        end, last = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content, False
        while not last:
            if end + 3 > len(data):
                raise WarcError("cut frame")
            header = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(header & 1), header >> 1 & 3, header >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 if flags >> 2 & 1 else 0
    else:
        raise WarcError(f"no frame at byte {at}")
    if end > len(data):
        raise WarcError("cut frame")
    return end


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, one frame each."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = frame_end(view, 0)
        body = bytes(view[8:at])
        if body[:4] == struct.pack("<I", FRAME):
            body = zstandard.ZstdDecompressor().decompress(body)
        if body[:4] != struct.pack("<I", DICTIONARY):
            raise WarcError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(body)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(view, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME:
            yield decoder.decompress(view[at:end])
        at = end


def _dictionary(records: list[bytes]):
    """A dictionary of the first records, or none where they are too few."""
    import zstandard

    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(64 << 10, max(1 << 10, total // 20)), records) if len(records) >= 16 and total >= 1 << 16 else None
    except zstandard.ZstdError:
        return None


def archives(records: Iterator[bytes], archive_bytes: int, first_bytes: int = 2 << 20) -> Iterator[tuple[bytes, int]]:
    """(archive, number of its records), each of about ``archive_bytes`` at most."""
    import zstandard

    records = iter(records)
    while True:
        opening, size = [], 0
        for record in records:
            opening.append(record)
            size += len(record)
            if size >= first_bytes:
                break
        if not opening:
            return
        out, count = bytearray(), 0
        if dictionary := _dictionary(opening):
            plain = dictionary.as_bytes()
            body = min(plain, zstandard.ZstdCompressor(level=9).compress(plain), key=len)
            out += struct.pack("<II", SKIPPABLE, len(body)) + body
            encoder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        else:
            encoder = zstandard.ZstdCompressor(level=3, write_checksum=True)
        for record in opening:
            out += encoder.compress(record)
            count += 1
        while len(out) < archive_bytes and (record := next(records, None)) is not None:
            out += encoder.compress(record)
            count += 1
        yield bytes(out), count


def _store(folder: str, name: str, data: bytes, attempt: int) -> str:
    """Write under a name of this attempt, then rename."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    draft, final = f"{root}/.{name}.{attempt}", f"{root}/{name}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, final)
    return final


def with_record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_from: int = 1000) -> DataFrame:
    """(key, url, payload, keep): ``keep`` is the id that others with an equal payload refer to, if any."""
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload"), "guard": F.xxhash64("payload")})
    same = ["digest", "size", "guard"]
    groups = rows.where(F.col("size") >= revisit_from).groupBy(*same).agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups, "warc-repeats")
    shown = ["key", "url", "payload", "keep"]
    if groups.count() <= _MOST_BROADCAST:
        return rows.join(F.broadcast(groups.drop("n")), same, "left").select(*shown)
    total = groups.agg(F.sum("n")).first()[0]
    common = F.col("n") > total // _MOST_BROADCAST  # so many payloads at most: their pages are not shuffled
    hot = F.broadcast(groups.where(common).drop("n"))
    rest = rows.join(hot.drop("keep"), same, "left_anti").join(groups.where(~common).drop("n"), same, "left")
    return rows.join(hot, same).select(*shown).union(rest.select(*shown))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_from: int = 1000, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write archives below ``folder`` (a URI every executor reaches); one row (path, records, bytes) for each.

    Archives are named by the attempt that wrote them, and the rows are a written table, which holds one attempt of
    every task: archives of an attempt that was lost, or ran beside another, are in no row and are not read."""
    rows = with_record_types(pages, id_col, payload_col, url_col, revisit_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for piece in slices(batch, "payload"):
                    for key, url, payload, keep in zip(*(piece.column(c).to_pylist() for c in ("key", "url", "payload", "keep")), strict=True):
                        yield make_record(key, url, payload.encode("utf-8"), keep, keep is not None and key != keep)

        for k, (data, count) in enumerate(archives(records(), archive_bytes)):
            path = _store(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{k:05d}.warc.zst", data, context.taskAttemptId())
            yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": len(data)}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(mapped(rows, run, "path string, records long, bytes long"), "warc-list")


def read_warc(spark: SparkSession, folder: str, listed: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """Records of all archives below ``folder``, or of those ``listed`` (path, ...): key, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if listed is not None:
        names = listed.select(name(F.col("path")).alias("name")).distinct()
        few = names.count() <= _MOST_BROADCAST
        files = files.withColumn("name", name(F.col("path"))).join(F.broadcast(names) if few else names, "name", "left_semi")
    files = files.select("content")
    schema = pa.schema([("key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "content"):
                for data in piece.column("content").to_pylist():
                    out, size = [], 0
                    for raw in read_archive(data):
                        x = parse_record(raw)
                        h, kind = x["headers"], x["headers"]["WARC-Type"]
                        refers = key_of(h["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append({"key": key_of(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": x["payload_bytes"], "payload_digest": x["digest"], "refers_to": refers, "payload": x["payload"] if with_payload and kind == "response" else None})
                        size += len(raw)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return mapped(files, run, "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS keep FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM g
"""


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_path(spark, "warc")
    listed = write_warc(pages, folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    if not listed.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]:
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    back = read_warc(spark, folder, listed, with_payload=False)
    return back.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
