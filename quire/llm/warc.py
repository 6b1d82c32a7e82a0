"""WARC archives in Zstandard: one frame a record, and a dictionary in a leading skippable frame.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a
Zstandard frame or as it is, followed by one frame for each record. The reader loads the
dictionary from the leading frame, decodes frame after frame, and checks version line,
required headers, Content-Length against the block, and digests; a record that fails is
returned with its error, and reading goes on at the next frame.

Archives are rows of a table (archive, content) of about ARCHIVE_BYTES each, so that they are
written and read by Spark on any shared file system; spark.read.format("binaryFile") gives the
same content column for .warc.zst files. The dictionary is trained in each archive's task on a
bounded sample: up to SAMPLES of its first records, SAMPLE_BYTES in all.

Duplicates: of records with equal payloads of at least REVISIT bytes the one with the largest
page_id is a response, others are revisits that refer to it; smaller ones are all responses.
The largest id comes from a pre-summed aggregate by digest; the hot digests are split by a salt
when they are joined back.

Cases: a null payload is empty; a record without an id is a response that none refers to;
repeated rows give repeated records, all of the largest id being responses; an empty table
gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, pieces

MAGIC = 0x184D2A5D
REVISIT, SALTS = 1000, 32
ARCHIVE_BYTES, DICT_BYTES, SAMPLES, SAMPLE_BYTES, LEVEL = 16 << 20, 64 << 10, 400, 4 << 20, 3
#: The longest record that a reader takes: a length in a damaged frame must not fill the memory.
RECORD_BYTES = 1 << 30
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


# --- records ---


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, serial: str = "") -> bytes:
    """A WARC/1.1 record: a revisit carries no block, but the length and digest of its full payload.

    Its id is made of its content and a serial number, so that repeated rows and rows without an id have ids of their own; pages are named in headers of ours."""
    block = b"" if kind == "revisit" else payload
    name = uuid.UUID(bytes=hashlib.sha1(f"{serial}:{page_id}:{url}:{hashlib.sha1(payload).hexdigest()}".encode()).digest()[:16], version=5)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the block of one record; ValueError says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("headers don't end")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header {line[:40]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no header {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block has {max(0, len(rest) - 4)} bytes")
    block = rest[:n]
    digests = [("warc-block-digest", block)] + [("warc-payload-digest", block)] * (headers["warc-type"] == "response")
    for name, of in digests:
        if (d := headers.get(name, "")).startswith("sha1:") and len(d) == 45 and hashlib.sha1(of).hexdigest() != d[5:].lower():
            raise ValueError(f"{name} differs")
    return headers, block


# --- archives ---


def write_archive(records: list[bytes]) -> bytes:
    """The leading dictionary frame, where the records suffice to train one, and a frame for each record."""
    samples, size = [], 0
    for r in records[:SAMPLES]:
        samples.append(r)
        if (size := size + len(r)) > SAMPLE_BYTES:
            break
    trained = None
    if len(samples) >= 8 and size >= 8 * 1024:
        try:
            trained = zstandard.train_dictionary(min(DICT_BYTES, size // 8), samples, k=512, d=8)
        except zstandard.ZstdError:
            trained = None  # too little to learn from
    out = []
    if trained:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out.append(struct.pack("<II", MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([*out, *(c.compress(r) for r in records)])


def frames(content: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, decoded frame, error) of an archive: the leading dictionary is loaded, other skippable frames are passed over.

    A frame that can't be decoded ends at the next frame's magic that decodes or at the end."""
    at, dictionary, view = 0, None, memoryview(content)
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            yield 0, None, "dictionary frame is cut"
            return
        raw = bytes(view[8 : 8 + size])
        try:
            dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw, max_output_size=RECORD_BYTES) if raw.startswith(ZSTD_MAGIC) else raw)
        except zstandard.ZstdError as e:
            yield 0, None, f"dictionary: {e}"
            return
        at = 8 + size
    d = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        if at + 8 <= len(content) and (struct.unpack_from("<I", content, at)[0] & 0xFFFFFFF0) == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        start = at
        try:
            if zstandard.frame_content_size(view[at : at + 18]) > RECORD_BYTES:
                raise zstandard.ZstdError("a record of more bytes than are taken")
            o = d.decompressobj()
            parts, size, fed = [], 0, at
            while not o.eof:
                if fed >= len(content):
                    raise zstandard.ZstdError("frame is cut")
                parts.append(o.decompress(view[fed : fed + (64 << 10)]))
                fed += 64 << 10
                if (size := size + len(parts[-1])) > RECORD_BYTES:
                    raise zstandard.ZstdError("a record of more bytes than are taken")
            at = min(fed, len(content)) - len(o.unused_data)
            yield start, b"".join(parts), None
        except zstandard.ZstdError as e:
            yield start, None, str(e)
            at = content.find(ZSTD_MAGIC, start + 1)
            if at < 0:
                return


# --- over DataFrames ---


def marked(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, kind, refers_to: which record is a response and which revisits another."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= REVISIT)).select("page_id", F.sha1("payload").alias("digest"))
    heads = keyed.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(heads, ["digest", "salt"]).filter("page_id <> head").select("page_id", "digest", "head").distinct()
    joined = pages.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT, F.sha1("payload"))).join(revisits, ["page_id", "digest"], "left")
    again = F.col("head").isNotNull()
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("head")).alias("refers_to"))


def write(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """archive, content: each task packs its rows into archives of about ARCHIVE_BYTES of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, number = [], 0, TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            content = write_archive(held)
            name = f"{hashlib.sha1(content).hexdigest()[:20]}.warc.zst"
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for b in pieces(batches):
            for r in b.to_pylist():
                number += 1
                held.append(record(r["page_id"], r["url"], bytes(r["payload"]), r["kind"], r["refers_to"], f"{part}:{number}"))
                if (size := size + len(held[-1])) >= ARCHIVE_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    return bounded(marked(df, id_col, url_col, payload_col)).mapInArrow(run, "archive string, content binary")


READ = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of (archive, content) rows, in READ's columns and, if asked for, the payload (binary; null in revisits)."""
    schema = READ + ", payload binary" * payloads
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[t]) for n, t in (x.split() for x in schema.split(", "))])

    def page(x: str | None) -> int | None:
        return int(x) if x and x.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["archive"].to_pylist(), b["content"].to_pylist(), strict=True):
                rows, size = [], 0
                for offset, data, error in frames(content or b""):
                    row = dict.fromkeys(arrow.names) | {"archive": name, "offset": offset, "error": error}
                    if data is not None:
                        try:
                            h, block = parse(data)
                            row |= {"page_id": page(h.get("x-page-id")), "record_type": h["warc-type"], "payload_bytes": int(h.get("x-payload-length", len(block))), "refers_to": page(h.get("x-refers-to-page-id"))}
                            row |= {"payload_digest": h.get("warc-payload-digest", "sha1:" + hashlib.sha1(block).hexdigest())[5:]}
                            if payloads and h["warc-type"] != "revisit":
                                row["payload"] = block
                        except (ValueError, UnicodeDecodeError) as e:
                            row["error"] = str(e)
                    rows.append(row)
                    size += len(data or b"") * payloads + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return bounded(archives).select("archive", "content").mapInArrow(run, schema)
