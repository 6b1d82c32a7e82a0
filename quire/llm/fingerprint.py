"""Document fingerprints by improved consistent weighted sampling.

A document is the bag of its words, each weighted by its number of occurrences. For word x of
weight w and sample k, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from a hash of (x, k):
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r. The word of least ln a and its t make the
k-th part of the signature, so that the share of equal parts in two signatures estimates the
generalised Jaccard similarity of the bags, sum of minima over sum of maxima.

`with_next` also compares each document with its successor in descending order of doc_id, and
with an edited text that takes the successor's beginning. Texts cross one exchange, dealt into
ranges of doc_id that are cut at near equal bytes: quantiles of a sample of the ids, by hash, make
BUCKETS cells at most, however ids are spread, and the bytes of each cell are counted over all rows.
The first document of each range is sent to the range before it as well, so no range needs a second look.

Cases: null texts are empty, and an empty bag has a signature of its own; rows of one id follow
each other by text and stay in one range; rows without an id come last; a single document is its own
successor; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.ranges import at_or_below
from quire.llm.common import arrow_map, literal, pieces, texts

SAMPLES, BUCKETS = 64, 1 << 15
#: Ids that the quantiles are taken of, about.
SAMPLED = 1 << 17
#: (word, weight) pairs whose samples a worker remembers.
CACHE = 120_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Signatures of weighted bags; equal in every process."""

    def __init__(self, samples: int = SAMPLES, cache: int = CACHE):
        self.samples, self.cache = samples, cache
        self.at: dict[tuple[str, int], int] = {}
        self.rows = np.empty((0, samples), np.uint64)
        self.steps = (np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, samples)

    def draws(self, pairs: list[tuple[str, float]]) -> np.ndarray:
        """For each pair and sample ln a in the upper half, as bits that sort as it does, and a hash of (word, t) below."""
        h = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x, _ in pairs], np.uint64)[:, None]
        w = np.log(np.array([w for _, w in pairs], np.float64))[:, None]
        words = [_mixed(h + s) for s in self.steps]
        unit = lambda x: (x.astype(np.float64) + 0.5) / 2**32
        r, c = (-np.log(unit(x >> np.uint64(32)) * unit(x & np.uint64(0xFFFFFFFF))) for x in words[:2])
        b = unit(words[2] >> np.uint64(32))
        t = np.floor(w / r + b)
        a = (np.log(c) - r * (t - b + 1)).astype(np.float32).view(np.uint32)
        a = np.where(a >> np.uint32(31), ~a, a | np.uint32(1 << 31)).astype(np.uint64)
        part = _mixed(h + t.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)
        return a << np.uint64(32) | part

    def _least(self, items: list[tuple[str, int]]) -> np.ndarray:
        found = [*map(self.at.get, items)]
        if None in found:
            new = [p for p, i in zip(items, found, strict=True) if i is None]
            if len(self.at) + len(new) > self.cache:
                self.at.clear()
                return self._least(items)
            if len(self.rows) < len(self.at) + len(new):
                self.rows = np.concatenate([self.rows[: len(self.at)], np.empty((min(self.cache, 2 * len(self.rows) + len(new)) - len(self.at), self.samples), np.uint64)])
            first = len(self.at)
            self.rows[first : first + len(new)] = self.draws(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            found = [*map(self.at.get, items)]
        return self.rows[found].min(axis=0)

    def signature(self, bag: Counter) -> np.ndarray:
        """The parts of a bag's signature, unsigned 32-bit integers."""
        items = list(bag.items()) or [("", 1)]
        step = max(1, self.cache // 4)
        least = self._least(items[:step])
        for i in range(step, len(items), step):
            least = np.minimum(least, self._least(items[i : i + step]))
        return least.astype(np.uint32)

    def of(self, text: str) -> np.ndarray:
        return self.signature(Counter(text.split()))


_samplers: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    """The worker's sampler."""
    return _samplers.setdefault(samples, Sampler(samples))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(signature: np.ndarray) -> str:
    """A signature in hexadecimal, eight digits a part."""
    return signature.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text; no exchange."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        s = sampler(samples)
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([written(s.of(t)) for t in b["text"].to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return arrow_map(texts(df, id_col, text_col), of, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many of the next text's first code points, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


WITH_NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """docs with the range `part` and `extra`, 1 for the first documents of the following range, which close this one.

    Ranges go up with doc_id; of each bucket of ids the driver gets one row, BUCKETS at most."""
    ids, span = docs.select("doc_id").filter(F.col("doc_id").isNotNull()), 1 << 30
    share = span if (n := ids.count()) <= SAMPLED else span * SAMPLED // n
    seen = sorted(r.doc_id for r in ids.filter(F.pmod(F.xxhash64(F.lit("range"), "doc_id"), F.lit(span)) < share).distinct().collect())
    bounds = seen[:: max(1, -(-len(seen) // (BUCKETS - 1)))]
    low = seen[0] if seen else 0
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at_or_below(F.col("doc_id"), bounds) + 1)
    docs = docs.withColumn("bucket", bucket)  # rows without an id sort below all others
    bucket = F.col("bucket")
    seen = docs.groupBy("bucket").agg(F.sum(F.octet_length("text") + 200).alias("weight"), F.max("doc_id").alias("top")).collect()
    seen.sort(key=lambda r: r.bucket)
    target = max(1, sum(r.weight for r in seen) / parts)
    part_of, tops, at, part = [0] * (BUCKETS + 2), [], 0, -1
    for r in seen:
        if part < int(at / target):
            part += 1
            tops.append(None)
        part_of[r.bucket] = part
        tops[part] = r.top
        at += r.weight
    n = len(tops)
    if not n:
        return docs.withColumns({"part": F.lit(0), "extra": F.lit(0)}), 1
    part = F.element_at(literal(part_of, "int"), bucket + 1)
    own = F.struct(part.alias("part"), F.lit(0).alias("extra"))
    closing = F.struct(F.pmod(part + 1, F.lit(n)).alias("part"), F.lit(1).alias("extra"))
    top = F.try_element_at(literal([low if t is None else t for t in tops], "long"), part + 1)
    first = F.when(F.element_at(literal([int(t is None) for t in tops], "int"), part + 1) == 1, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == top)
    dealt = docs.withColumn("to", F.explode(F.when(F.coalesce(first, F.lit(False)), F.array(own, closing)).otherwise(F.array(own))))
    return dealt.select("doc_id", "text", "to.part", "to.extra"), n


def with_next(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """WITH_NEXT's columns: fingerprints of each text and of its edited one, and how near they and the next document's are."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = _ranges(texts(df, id_col, text_col), 4 * partitions)
    dealt = dealt.repartition(partitions, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, waiting, part = sampler(samples), None, None
        names = [x.split()[0] for x in WITH_NEXT.split(", ")]
        for b in pieces(batches):
            rows = [[] for _ in names]
            for doc_id, text, of, extra in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "part", "extra")), strict=True):
                if of == part and waiting is None:
                    continue  # closed already
                part, own = of, s.of(text)
                if waiting is not None:
                    i, t, f = waiting
                    new = edited(t, text)
                    g = s.of(new)
                    for out, x in zip(rows, (i, len(t), hashlib.sha256(new.encode()).hexdigest(), written(f), written(g), likeness(f, g), likeness(f, own)), strict=True):
                        out.append(x)
                waiting = None if extra else (doc_id, text, own)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64() if i < 2 else pa.string() if i < 5 else pa.float64()) for i, r in enumerate(rows)], names)

    return dealt.mapInArrow(run, WITH_NEXT)
