"""Removal of byte strings that an earlier document holds too, by suffix arrays of shards.

A byte goes if it is covered by a string of `length` bytes that also starts in a document of a
smaller id. All strings are judged on the input, so nothing depends on an order of removal.

Documents are packed into chunks, written once to the shared folder. Every string of `length` bytes
has an anchor, the least of its grams of GRAM bytes by hash, which any equal string has at the same
place; strings that follow each other mostly share it, and their stretch is the anchor's context.

1. Each chunk sends the hashes of its anchors to the shards, 5 bytes each and once a chunk; a shard
   answers which of them more than one document holds. An anchor that one document holds can't
   be in a common string, so nothing is lost here.
2. Each chunk sends the different contexts of the anchors that are left, with the least document
   id that it has for each. A context that is alone with its anchor is one string for all who hold it.
   The others are joined to the shard's text, whose suffix array and common prefixes are built by
   external induced sorting (see suffix.py): neighbours with `length` bytes in common or more start with one string,
   and the least id among them is sent back.
3. Each chunk marks what documents of a smaller id hold, and cuts.

A chunk answers for all its documents, so a passage that stands in each document costs a row a chunk and shard,
never a row for each pair or each occurrence. Texts cross one exchange, and both joins keep to its partitioning.

Cases: null texts are empty; a row without an id counts as later than all others; rows of one id never
remove anything from each other; a document shorter than `length` stays; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import suffix
from quire.llm.common import cut, pieces, texts

LENGTH, GRAM = 50, 24
#: Raw bytes of a chunk about, bytes of text for each shard, and shards at most; a shard larger than memory is sorted on disk.
CHUNK, SHARD, SHARDS = 4 << 20, 6 << 20, 1 << 14
#: Positions hashed at a time.
BLOCK = 1 << 15
NOBODY = np.iinfo(np.int64).max

_multiplier = np.uint64(0x9E3779B97F4A7C15)
_of_byte = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


# --- anchors ---


def _power(e: int) -> np.uint64:
    return np.uint64(pow(int(_multiplier), e, 1 << 64))


def hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each position, put together from grams of powers of two."""
    known, m = {1: _of_byte[data]}, 1
    while 2 * m <= gram:
        x = known[m]
        known[2 * m] = x[:-m] * _power(m) + x[m:]
        m *= 2
    out, size = None, 0
    for m in sorted(known, reverse=True):
        if gram & m:
            n = len(data) - size - m + 1
            out = known[m][:n] if out is None else out[:n] * _power(m) + known[m][size : size + n]
            size += m
    x = out
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    m, out = 1, x
    while 2 * m <= width:
        out = np.minimum(out[:-m], out[m:])
        m *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - m :]) if m < width else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents that end at `ends`: each anchor's hash, its document, and its context's bounds.

    Of equal hashes the leftmost is the anchor: it depends on the string's own bytes alone."""
    span, keys, starts, stops = length - gram + 1, [], [], []
    low = np.uint64((1 << 20) - 1)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        h = hashes(data[at : at + BLOCK + length - 1], gram)
        p = _least(h & ~low | np.arange(len(h), dtype=np.uint64), span) & low
        # strings that would run into the next document: the last length - 1 starts of each, or all of a short one
        near = slice(np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + len(p), "left"))
        edges = np.zeros(len(p) + 1, np.int32)
        np.add.at(edges, np.clip(np.maximum(begins[near], ends[near] - length + 1) - at, 0, len(p)), 1)
        np.add.at(edges, np.clip(ends[near] - at, 0, len(p)), -1)
        ok = np.cumsum(edges[:-1]) == 0
        moved = (p[1:] != p[:-1]) | ~(ok[1:] & ok[:-1])
        first = np.flatnonzero(ok & np.concatenate([[True], moved]))
        keys.append(h[p[first].astype(np.int64)])
        starts.append(first + at)
        stops.append(np.flatnonzero(ok & np.concatenate([moved, [True]])) + at + length)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    found = np.concatenate(starts)
    return np.concatenate(keys), np.searchsorted(ends, found, "right"), found, np.concatenate(stops)


def bytes_of(values: pa.Array) -> bytes:
    """The values of a large_binary array without nulls, joined."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if len(values) else b""


class Chunk:
    """A chunk's documents, with what all three passes derive from them alike."""

    def __init__(self, ids: list, lengths: bytes, body: bytes, length: int, gram: int, shards: int):
        self.ids = ids
        self.order = np.array([NOBODY if i is None else i for i in ids], np.int64)
        sizes = np.frombuffer(lengths, np.int64)
        self.ends, self.begins = np.cumsum(sizes), np.cumsum(sizes) - sizes
        self.body = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(sizes.sum()) + 1) if len(body) else b""
        self.data = np.frombuffer(self.body, np.uint8)
        self.length, self.shards = length, shards
        self.keys, self.docs, self.starts, self.stops = anchors(self.data, self.ends, length, gram)

    def hashes(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, hashes, whether two documents of the chunk hold it) of the chunk's different anchors."""
        if not len(self.keys):
            return []
        order = np.lexsort((self.docs, self.keys))
        keys, docs = self.keys[order], self.docs[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.concatenate([head[1:], [len(keys)]]) - 1
        unique, many = keys[head], docs[head] != docs[last]
        shard = (unique % np.uint64(self.shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(shard[by]) != 0, [True]]))
        return [(int(shard[by[a]]), unique[by[a:b]], many[by[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def contexts(self, told: dict[int, bytes]) -> tuple[list[tuple[int, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Of the anchors told to be common (shard, hashes, contexts, least id of each, whether one id has it, its number); all occurrences by number, and where each number's begin.

        A context's own bytes tell its anchor, so that contexts alone are numbered."""
        common = np.sort(np.concatenate([keys[np.unpackbits(np.frombuffer(told[s], np.uint8), count=len(keys)).astype(bool)] for s, keys, _ in self.hashes() if s in told] or [np.empty(0, np.uint64)]))
        if not len(common):
            return [], np.empty(0, np.int64), np.zeros(1, np.int64)
        place = np.minimum(np.searchsorted(common, self.keys), len(common) - 1)
        seen = np.flatnonzero(common[place] == self.keys)
        body = self.body
        encoded = pa.array([body[s:e] for s, e in zip(self.starts[seen].tolist(), self.stops[seen].tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        number, contexts = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        ids = self.order[self.docs[seen]]
        least = np.full(len(contexts), NOBODY)
        np.minimum.at(least, number, ids)
        most = np.full(len(contexts), np.iinfo(np.int64).min)
        np.maximum.at(most, number, ids)
        by_number = np.argsort(number, kind="stable")
        occurrences = seen[by_number]
        firsts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(contexts)))])
        keys = self.keys[occurrences[firsts[:-1]]]
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(shard[by]) != 0, [True]]))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = by[a:b]
            out.append((int(shard[own[0]]), keys[own], contexts.take(pa.array(own)), least[own], least[own] == most[own], own))
        return out, occurrences, firsts

    def cut(self, told: dict[int, bytes], found: dict[int, bytes]) -> list[tuple]:
        """(id, bytes, removed, runs, digest of what is left) of each document."""
        edges = np.zeros(len(self.data) + 1, np.int32)
        by_shard, occurrences, firsts = self.contexts(told) if found else ([], None, None)
        for shard, *_, own in by_shard:
            if shard not in found:
                continue
            rows = np.frombuffer(found[shard], FOUND)
            number = own[rows["number"]]
            times = firsts[number + 1] - firsts[number]
            of = np.repeat(np.arange(len(rows)), times)
            seen = occurrences[np.arange(len(of)) - np.repeat(np.cumsum(times) - times - firsts[number], times)]
            later = self.order[self.docs[seen]] > rows["least"][of]
            seen, of = seen[later], of[later]
            np.add.at(edges, self.starts[seen] + rows["start"][of].astype(np.int64), 1)
            np.add.at(edges, self.starts[seen] + rows["stop"][of].astype(np.int64) - 1 + self.length, -1)
        gone = np.cumsum(edges[:-1]) > 0
        out = []
        for i, b, e in zip(self.ids, self.begins.tolist(), self.ends.tolist(), strict=True):
            g = gone[b:e]
            runs = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
            out.append((i, e - b, int(np.count_nonzero(g)), runs, hashlib.sha256(self.data[b:e][~g].tobytes()).hexdigest()))
        return out


# --- shards ---

#: What a shard tells a chunk: for strings start..stop of a context the least id of a document that holds them.
FOUND = np.dtype([("number", "<u4"), ("start", "u1"), ("stop", "u1"), ("least", "<i8")])
#: The upper half of a hash suffices inside a shard: what it takes for equal is told apart by the context.
ENTRY = np.dtype([("key", "<u4"), ("size", "u1"), ("single", "u1"), ("least", "<i8")])


def packed_hashes(keys: np.ndarray, many: np.ndarray) -> bytes:
    """39 bits of each hash and whether it is common already; with the shard's number they tell hashes well enough apart."""
    x = (keys >> np.uint64(24) << np.uint64(1)) | many.astype(np.uint64)
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32) & np.uint64(0xFF)).astype("u1").tobytes()


def common_hashes(blobs: list[bytes]) -> list[bytes]:
    """For each chunk's hashes bits that tell which of them another document holds; hashes taken for equal only cost work."""
    values = []
    for b in blobs:
        n = len(b) // 5
        values.append(np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32))
    x = np.concatenate(values)
    unique, of, times = np.unique(x >> np.uint64(1), return_inverse=True, return_counts=True)
    common = times > 1
    common[of[(x & np.uint64(1)) == 1]] = True
    return [np.packbits(c).tobytes() for c in np.split(common[of], np.cumsum([len(v) for v in values])[:-1])]


def packed_contexts(keys: np.ndarray, contexts: pa.Array, least: np.ndarray, single: np.ndarray) -> bytes:
    """What a chunk tells a shard: the number of contexts, an ENTRY for each, and their bytes."""
    e = np.empty(len(keys), ENTRY)
    e["key"], e["size"], e["single"], e["least"] = keys >> np.uint64(32), pc.binary_length(contexts).to_numpy(), single, least
    return zstandard.ZstdCompressor(level=1).compress(len(e).to_bytes(4, "little") + e.tobytes() + bytes_of(contexts))


def least_holders(windows: pa.Array, least: np.ndarray, length: int, memory: int = suffix.MEMORY) -> np.ndarray:
    """For each string of `length` bytes of each text, one after the other, the least id among the texts that hold it, by the texts' suffix array."""
    sizes = pc.binary_length(windows).to_numpy()
    begins = np.cumsum(sizes + 1) - sizes - 1
    chars = np.empty(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    inside = np.ones(len(chars), bool)
    inside[begins[1:] - 1] = inside[-2:] = False
    chars[inside] = np.frombuffer(bytes_of(windows), np.uint8).astype(np.uint16) + np.uint16(2)
    chars[begins[1:] - 1] = 1
    chars[-2:] = 1, 0
    at, prefix = suffix.suffixes_with_prefixes(chars, 258, length, memory)
    text = np.searchsorted(begins, at, "right") - 1
    offset = at - begins[text]
    group = np.cumsum(prefix < length)
    whole = offset <= sizes[text] - length
    group, text, offset = group[whole], text[whole], offset[whole]
    first = np.full(int(group[-1]) + 1, NOBODY)
    np.minimum.at(first, group, least[text])
    counts = sizes - length + 1
    out = np.empty(int(counts.sum()), np.int64)
    out[(np.cumsum(counts) - counts)[text] + offset] = first[group]
    return out


def shard_answers(blobs: list[bytes], length: int, memory: int = suffix.MEMORY) -> list[bytes]:
    """FOUND rows for each chunk's contexts of a shard."""
    entries, contexts = [], []
    for b in blobs:
        b = zstandard.ZstdDecompressor().decompress(b)
        n = int.from_bytes(b[:4], "little")
        entries.append(e := np.frombuffer(b, ENTRY, n, 4))
        offsets = np.concatenate([[0], np.cumsum(e["size"], dtype=np.int64)]) + 4 + n * ENTRY.itemsize
        contexts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b)]))
    encoded = pa.concat_arrays(contexts).dictionary_encode()
    number, known = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    e = np.concatenate(entries)
    least, keys = np.full(len(known), NOBODY), np.empty(len(known), np.uint32)
    np.minimum.at(least, number, e["least"])
    keys[number] = e["key"]
    _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
    others = np.flatnonzero(times[of] > 1)
    # runs of strings with one least holder; a context that is alone with its anchor is one run
    strings = pc.binary_length(known).to_numpy() - length + 1
    text, start, stop, first = np.arange(len(known)), np.zeros(len(known), np.int64), strings, least
    if len(others):
        x = least_holders(known.take(pa.array(others)), least[others], length, memory)
        begins = np.cumsum(strings[others]) - strings[others]
        new = np.concatenate([[True], x[1:] != x[:-1]])
        new[begins] = True
        head = np.flatnonzero(new)
        place = np.searchsorted(begins, head, "right") - 1
        alone = np.flatnonzero(times[of] == 1)
        text = np.concatenate([alone, others[place]])
        start = np.concatenate([start[alone], head - begins[place]])
        stop = np.concatenate([stop[alone], np.concatenate([head[1:], [len(x)]]) - begins[place]])
        first = np.concatenate([first[alone], x[head]])
    by = np.argsort(text, kind="stable")
    start, stop, first = start[by], stop[by], first[by]
    runs = np.bincount(text, minlength=len(known))
    firsts = np.cumsum(runs) - runs
    out, done = [], 0
    for e in entries:
        own = number[done : done + len(e)]
        done += len(e)
        of = np.repeat(np.arange(len(e)), runs[own])
        at = np.arange(len(of)) + np.repeat(firsts[own] - (np.cumsum(runs[own]) - runs[own]), runs[own])
        told = (first[at] < e["least"][of]) | (e["single"][of] == 0)
        rows = np.empty(int(np.count_nonzero(told)), FOUND)
        rows["number"], rows["start"], rows["stop"], rows["least"] = of[told], start[at[told]], stop[at[told]], first[at[told]]
        out.append(rows.tobytes())
    return out


# --- over DataFrames ---


def chunked(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, ids, lengths, body: whole documents packed in each task, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(t for _, t in held))
            lengths = np.array([len(t) for _, t in held], np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([lengths], pa.binary()), pa.array([body], pa.binary())], ["ids", "lengths", "body"])

        for b in pieces(batches):
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                t = t.encode()
                if held and size + len(t) > chunk:
                    yield out()
                    held, size = [], 0
                held.append((i, t))
                size += len(t)
        if held:
            yield out()

    return docs.mapInArrow(run, "ids array<long>, lengths binary, body binary").withColumn("chunk", F.monotonically_increasing_id())


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(df: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """CUT's columns for every document."""
    if not 2 <= gram <= length <= 127:
        raise ValueError("gram must be from 2 to length, and length 127 at most")
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.getAll.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan doesn't tell its partitioning, and the joins need it
    try:
        chunks = cut(chunked(texts(df, id_col, text_col), chunk).repartition(partitions, "chunk"))
    finally:
        if adaptive is None:
            spark.conf.unset("spark.sql.adaptive.enabled")
        else:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, min(SHARDS, 2 * size // shard))
    make = lambda b, r: Chunk(b["ids"][r].as_py(), b["lengths"][r].as_py(), b["body"][r].as_py(), length, gram, shards)
    blob_schema = "shard int, chunk long, blob binary"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "chunk", "blob"])

    def told(b: pa.RecordBatch, r: int, column: str) -> dict[int, bytes]:
        return {x["shard"]: x["blob"] for x in b[column][r].as_py() or ()}

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                if rows := [(s, b["chunk"][r].as_py(), packed_hashes(k, m)) for s, k, m in make(b, r).hashes()]:
                    yield batch(rows)

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                rows = []
                for s, keys, contexts, least, single, _ in make(b, r).contexts(told(b, r, "told"))[0]:
                    rows.append((s, b["chunk"][r].as_py(), packed_contexts(keys, contexts, least, single)))
                if rows:
                    yield batch(rows)

    def answer(of_blobs):
        def run(group: pa.Table) -> pa.Table:
            answers = of_blobs(group["blob"].to_pylist())
            return pa.Table.from_arrays([group["shard"], group["chunk"], pa.chunked_array([pa.array(answers, pa.binary())])], names=["shard", "chunk", "blob"])

        return run

    def by_chunk(sent: DataFrame, of_blobs, name: str) -> DataFrame:
        answers = sent.groupBy("shard").applyInArrow(answer(of_blobs), blob_schema)
        return cut(answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "blob")).alias(name)))

    common = by_chunk(chunks.mapInArrow(send_hashes, blob_schema), common_hashes, "told")
    known = chunks.join(common, "chunk", "left")
    found = by_chunk(known.mapInArrow(send_contexts, blob_schema), lambda blobs: shard_answers(blobs, length), "found")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                rows = make(b, r).cut(told(b, r, "told"), told(b, r, "found"))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], [x.split()[0] for x in CUT.split(", ")])

    return known.join(found, "chunk", "left").mapInArrow(finish, CUT)
