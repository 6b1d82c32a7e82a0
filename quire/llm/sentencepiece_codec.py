"""SentencePiece encoding and decoding that keeps the source offsets of every piece.

The normaliser walks the text by the longest prefix that the model's compiled character map
knows and records, for every byte that it writes, the source byte that it comes from; where a
model has no map, nothing but spaces changes and the walk is one replacement. The library's model,
its own normalisation switched off, segments what the normaliser has written. Piece lengths summed
over the normalised bytes then project each piece to a byte span of the original text. Ids are
those that the library gives for the original text.

Cases: a null or empty text has the begin and end ids only; repeated rows and ids give repeated rows; an empty
table gives no rows; columns other than id and text are not read. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quire.llm.common import arrow_map, texts

SPACE = "▁"
#: Chunks whose ids a worker remembers, and the longest chunk it remembers, in characters.
CACHE_CHUNKS, CACHE_CHARS = 300_000, 48
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(field number, value, the bytes of both) of a serialised protocol message; nested messages stay bytes."""
    i, n = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while i < n:
        first = i
        key, i = varint(i)
        if (kind := key & 7) == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, i = data[i : i + size], i + size
        yield key >> 3, value, data[first:i]


def wire(data: bytes):
    """(field number, value) of a serialised protocol message."""
    return ((field, value) for field, value, _ in fields(data))


def written(field: int, value: int | bytes) -> bytes:
    """A field of a protocol message: a whole number, or bytes."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return varint(field << 3) + varint(value) if isinstance(value, int) else varint(field << 3 | 2) + varint(len(value)) + value


NORMALISER = 3


def normalising(model: bytes, charsmap: bytes = b"", dummy_prefix: bool = False, remove_extra: bool = False, escape: bool = False) -> bytes:
    """The model with another normalisation; by default it has none."""
    spec = written(1, b"own") + written(2, charsmap) + written(3, int(dummy_prefix)) + written(4, int(remove_extra)) + written(5, int(escape))
    return b"".join(raw for field, _, raw in fields(model) if field != NORMALISER) + written(NORMALISER, spec)


class CharsMap:
    """Longest-prefix search in a compiled character map: a double-array trie, then its replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes consumed, replacement) of the longest known prefix at a position."""
        units, node, found = self.units, 0, None
        unit = units[0]
        pos = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        node = pos
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 255) != text[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = (i + 1 - at, units[node] & ((1 << 31) - 1))
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


@dataclass
class Normaliser:
    """A model's normalisation with alignment: of(text) gives bytes and, for each byte and the end, its source offset."""

    charsmap: CharsMap | None
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    suffix: bool
    user: list[bytes]

    @property
    def plain(self) -> bool:
        """Nothing but spaces changes."""
        return not (self.charsmap or self.remove_extra or self.user or self.suffix) and self.dummy_prefix and self.escape

    def of(self, text: bytes) -> tuple[bytes, np.ndarray]:
        return self._plain(text) if self.plain else self._walk(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        src = np.frombuffer(text, np.uint8)
        first = np.maximum.accumulate(np.where((src & 0xC0) != 0x80, np.arange(len(src), dtype=np.int64), 0))
        align = np.concatenate([np.zeros(3, np.int64), np.repeat(first, np.where(src == 32, 3, 1)), [len(src)]])
        return (b" " + text).replace(b" ", SPACE.encode()), align

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.user:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        if self.charsmap and (hit := self.charsmap.longest(text, at)):
            return hit[1], hit[0]
        b = text[at]
        size = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 0
        try:
            text[at : at + size].decode()
            if size and len(text) - at >= size:
                return text[at : at + size], size
        except UnicodeDecodeError:
            pass
        return "�".encode(), 1

    def _walk(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0
        if self.remove_extra:
            while at < len(text) and (p := self._prefix(text, at))[0] == b" ":
                at += p[1]
        if at == len(text):
            return b"", np.zeros(1, np.int64)

        def add(piece: bytes) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.dummy_prefix and not self.suffix:
            add(space)
        after_space = self.remove_extra
        while at < len(text):
            piece, used = self._prefix(text, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                add(piece.replace(b" ", space))
                after_space = piece.endswith(b" ")
            at += used
            after_space = after_space and self.remove_extra
        if self.remove_extra:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        if self.dummy_prefix and self.suffix:
            add(space)
        return bytes(out), np.array([*align, at], np.int64)


class Codec:
    """Encodes whole texts with spans and decodes ids, as the sentencepiece library does without sampling."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: Segments what is normalised already.
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=normalising(model))
        pieces, spec, trainer = [], {}, {}
        for field, value in wire(model):
            if field == 1:
                p = dict(wire(value))
                pieces.append((bytes(p.get(1, b"")), p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire(value))
            elif field == NORMALISER:
                spec = dict(wire(value))
        user = sorted((p for p, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        blob = spec.get(2, b"")
        self.normaliser = Normaliser(CharsMap(blob) if blob else None, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)), user)
        #: Normalised bytes that a piece of each id covers.
        self.covers = np.array([1 if kind == BYTE else 0 if kind == CONTROL else len(p) for p, kind in pieces], np.int64)
        self.unknown = next((i for i, (_, kind) in enumerate(pieces) if kind == UNKNOWN), -1)
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        #: No merge joins a space to what stands before it, so runs that start with spaces are encoded one by one.
        self.by_chunk = self.normaliser.plain and trainer.get(3, 1) == 2 and any(k == BYTE for _, k in pieces) and not any(k == NORMAL and crossing.search(p.decode()) for p, k in pieces)
        self.known: dict[str, bytes] = {}
        self.begin, self.end = (np.array([i] if i >= 0 else [], "<u4") for i in (self.sp.bos_id(), self.sp.eos_id()))

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of a text with the begin and end ids, as unsigned 32-bit integers."""
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a text with begin and end ids, and where each piece begins and ends in bytes of the original text.

        The last byte piece of a character has its span; the begin id has the empty span at 0 and the end id that at the end of the text."""
        norm, align = self.normaliser.of(text.encode())
        found = norm.decode()
        inner = self.inner(found)
        ids = np.concatenate([self.begin, inner, self.end])
        if self.unknown >= 0 and (inner == self.unknown).any():
            # unknown pieces cover whatever stands in the normalised text, so each is read from its surface
            covers = [len(piece.encode()) if i == self.unknown else int(self.covers[i]) for i, piece in zip(inner.tolist(), self.bare.encode(found, return_type=str), strict=True)]
            ends = np.cumsum([*[0] * len(self.begin), *covers, *[0] * len(self.end)])
        else:
            ends = np.cumsum(self.covers[ids])
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return ids, align[begins], align[ends]

    def inner(self, norm: str) -> np.ndarray:
        """The ids of a normalised text, without begin and end."""
        if not self.by_chunk or not norm:
            return np.array(self.bare.encode(norm), "<u4")
        known = self.known
        chunks = CHUNK.findall(norm)
        get = known.get
        out = [get(c) for c in chunks]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    c = chunks[i]
                    if (ids := get(c)) is None:
                        ids = np.array(self.bare.encode(c), "<u4").tobytes()
                        if len(c) <= CACHE_CHARS:
                            if len(known) >= CACHE_CHUNKS:
                                known.clear()
                            known[c] = ids
                    out[i] = ids
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """The worker's codec for a model file."""
    if model_path not in _codecs:
        with open(model_path, "rb") as f:
            _codecs[model_path] = Codec(f.read())
    return _codecs[model_path]


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered_bytes long"


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text with the byte span of each in the original: doc_id, ids, begins, ends."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(model_path), ([], [], [])
        for text in batch["text"].to_pylist():
            for out, x in zip(rows, c.aligned(text), strict=True):
                out.append(x.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.list_(pa.int32())) for x in rows)], ["doc_id", "ids", "begins", "ends"])

    return arrow_map(texts(df, id_col, text_col), of, ENCODED)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The library's decoding of each list of ids (null: none): doc_id, text."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([c.sp.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), of, "doc_id long, text string")


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text and keeps digests only; covered_bytes is where the last span ends."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, cols = codec(model_path), [[] for _ in range(5)]
        for text in batch["text"].to_pylist():
            ids, _, ends = c.aligned(text)
            row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), len(text.encode()), int(ends[-1]) if len(ends) else 0)
            for out, x in zip(cols, row, strict=True):
                out.append(x)
        return pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, cols)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "covered_bytes"])

    return arrow_map(texts(df, id_col, text_col), of, DIGESTS)
