"""SimHash near-duplicates by tiled exact comparison.

Words are what stands between ASCII white space once A-Z are lower-cased, shingles are
`words` of them (fewer: the whole text), and a bit of the fingerprint is set if it is set in
over half of the shingles' hashes. Fingerprints that differ in `radius` bits or fewer are linked.

Every pair of different fingerprints is compared, in tiles: fingerprints in order of their
population count are packed into tiles of up to TILE, a pair of tiles is skipped if their
counts differ beyond the radius, and inside a pair leaves of up to LEAF fingerprints are
skipped likewise by the counts of each quarter; what is left is compared by numpy's exclusive
or and bit counts. A tile travels once to each tile that it meets. A pair of tiles hands on a
spanning forest of its links, never the links, so that a large group of copies costs as many
rows as it has members. Links are joined into
components by alternating large and small stars, each round cut by a checkpoint.

Equal fingerprints are one class before anything is compared; classes, not documents, meet.
Wide fingerprints estimate a similarity more sharply: their first 128 bits are compared as above within a
radius that loses next to nothing, and a pair found is a link only if all bits agree within `exact`.
`keep_first` uses that for candidates of a Jaccard similarity of shingle sets: the radius lies BEYOND deviations above
what differs at most between such sets of any sizes. Sets of that similarity have numbers of shingles as near as that
to each other, too, so that tiles are cut by them first and tiles of sizes too far apart don't meet. Links are
confirmed inside the components of the candidates, by the whole sets (as 64-bit hashes): blocks of a component meet
in pairs, and in a pair each set is looked up by its shingles until all that it holds is joined. A large group of
copies is so joined by few sets.

The comparison is quadratic in the number of different fingerprints by nature of the method.

Cases: a null or empty text or one of white space alone has the fingerprint 0, which is
linked like any other; a component's id is its least doc_id, null if none has an id; repeated
rows are classed alike; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut, spare, texts

WORDS, RADIUS, BITS = 5, 4, 64
#: For near duplicates of a Jaccard similarity: all bits, and standard deviations that candidates are given beyond the bits expected to differ.
WIDE, SIMILAR, BEYOND = 256, 0.8, 3.5
#: Sets of a block at most, and their bytes.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Fingerprints of a tile at most and at least, tiles aimed at, and fingerprints of a leaf.
TILE, TILE_LEAST, TILES, LEAF = 262_144, 2_048, 32, 256
#: Shingles hashed at a time, and matches held before they are reduced to a forest.
HELD, MATCHES = 1 << 16, 1 << 20


def bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set: bytes are added up in groups that a byte can hold."""
    n = -(-len(rows) // 255)
    filled = np.zeros((n * 255, rows.shape[1]), np.uint8)
    filled[: len(rows)] = rows
    return np.unpackbits(filled, axis=1).reshape(n, 255, -1).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def widened(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of 128 bits followed by as many bits mixed from them as are wanted."""
    a, b = h.view(np.uint64).T
    out = np.empty((len(h), bits // 64), np.uint64)
    out[:, :2] = h.view(np.uint64)
    for k in range(2, bits // 64):
        x = a + b * np.uint64(2 * k + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out.view(np.uint8)


def fingerprint(text: str, words: int = WORDS, bits: int = BITS, repeats: bool = True) -> bytes:
    """Big-endian bytes: bits 64 takes XXH64 with seed 42, 128 XXH3, multiples of it widen that. Without repeats a shingle counts once."""
    return sketch(text, words, bits, repeats)[0]


def sketch(text: str, words: int = WORDS, bits: int = BITS, repeats: bool = True) -> tuple[bytes, int, bytes]:
    """The fingerprint, the number of shingles, and the sum of their hashes, which names a set of them."""
    w = text.encode().lower().split()
    if not w:
        return bytes(bits // 8), 0, b""
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[words - 1 :] - 1).tolist() if len(w) >= words else [len(joined)]
    digest = (lambda x: xxhash.xxh64_digest(x, 42)) if bits == 64 else xxhash.xxh3_128_digest
    shingles = [joined[s:e] for s, e in zip(starts, ends, strict=True)] if not repeats else None
    if shingles:
        shingles = list(dict.fromkeys(shingles))
        n = len(shingles)
    total, step, name = np.zeros(bits, np.int64), max(255, HELD * 64 // bits), np.zeros(min(bits, 128) // 64, np.uint64)
    for i in range(0, n, step):
        some = shingles[i : i + step] if shingles else [joined[s:e] for s, e in zip(starts[i : i + step], ends[i : i + step], strict=True)]
        h = np.frombuffer(b"".join(map(digest, some)), np.uint8).reshape(len(some), -1)
        total += bit_sums(h if bits <= 128 else widened(h, bits))
        name += h.view(np.uint64).sum(axis=0)
    return np.packbits(2 * total > n).tobytes(), n, name.tobytes()


def fingerprints(df: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """doc_id, fp (binary) of every whole text."""
    if bits != 64 and (bits < 128 or bits % 128):
        raise ValueError("bits must be 64 or a multiple of 128")

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([fingerprint(t, words, bits, repeats) for t in b["text"].to_pylist()], pa.binary())], ["doc_id", "fp"])

    return arrow_map(texts(df, id_col, text_col), of, "doc_id long, fp binary")


# --- tiles ---


def quarters(a: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint (rows of 64-bit words)."""
    return np.bitwise_count(a.view(np.uint8).reshape(len(a), 4, -1)).sum(axis=2, dtype=np.int16)


def leaves(a: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Order that splits the widest quarter at its median until leaves are small; their bounds and boxes."""
    q, order, ends = quarters(a), [], []
    todo = [np.arange(len(a))]
    while todo:
        rows = todo.pop()
        if len(rows) > leaf:
            spread = q[rows].std(axis=0)
            d = int(spread.argmax())
            by = rows[np.argsort(q[rows, d], kind="stable")]
            todo += [by[len(by) // 2 :], by[: len(by) // 2]]
        else:
            order.append(rows)
            ends.append(len(rows))
    order = np.concatenate(order)
    stops = np.cumsum(ends)
    bounds = [(int(e - n), int(e)) for e, n in zip(stops, ends, strict=True)]
    low = np.array([q[order[s:e]].min(axis=0) for s, e in bounds])
    high = np.array([q[order[s:e]].max(axis=0) for s, e in bounds])
    return order, bounds, low, high


def forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node that the links u-v put into a component with a lesser one."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        np.minimum.at(label, before[u], least)
        np.minimum.at(label, before[v], least)
        label = label[label]
        if np.array_equal(label, before):
            break
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def links(a: np.ndarray, b: np.ndarray | None, radius: int, exact: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a (b is None) or between a and b, as positions in a then b.

    With `exact`, the first two words agree within the radius and all within `exact`."""
    wide = (a, a if b is None else b)
    if exact is not None:
        a, b = np.ascontiguousarray(a[:, :2]), None if b is None else np.ascontiguousarray(b[:, :2])
    oa, la, lowa, higha = leaves(a)
    ob, lb, lowb, highb = (oa, la, lowa, higha) if b is None else leaves(b)
    sa, sb = np.ascontiguousarray(a[oa]), np.ascontiguousarray((a if b is None else b)[ob])
    shift, n = (0, len(a)) if b is None else (len(a), len(a) + len(b))
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0
    for i, (s, e) in enumerate(la):
        apart = np.maximum(0, np.maximum(lowa[i] - highb, lowb - higha[i])).sum(axis=1)
        for j in np.flatnonzero(apart <= radius):
            if b is None and j < i:
                continue
            t, f = lb[j]
            bits = np.bitwise_count(sa[s:e, None, 0] ^ sb[None, t:f, 0])
            for w in range(1, a.shape[1]):
                bits = bits + np.bitwise_count(sa[s:e, None, w] ^ sb[None, t:f, w])
            hit = bits <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                if b is None and i == j:
                    x, y = x[x < y], y[x < y]
                if exact is not None:
                    near = np.bitwise_count(wide[0][oa[s + x]] ^ wide[1][ob[t + y]]).sum(axis=1) <= exact
                    x, y = x[near], y[near]
                us.append(oa[s + x])
                vs.append(ob[t + y] + shift)
                held += len(x)
                if held > MATCHES:
                    u, v = forest(n, np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(n, np.concatenate(us), np.concatenate(vs))


def _tiles(distinct: DataFrame, n: int, bits: int, similarity: float) -> DataFrame:
    """tile, low, high (population counts), small, large (shingles), nodes and fps (packed) of the different fingerprints.

    Their order is by classes of the number of shingles, such that sets of the similarity are of one class or of neighbours, then by population count."""
    size = min(TILE, max(TILE_LEAST, -(-n // TILES)))
    words = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(nodes: list[int], sizes: list[int], data: list[bytes]) -> pa.RecordBatch:
            packed = b"".join(data)
            count = np.bitwise_count(np.frombuffer(packed, np.uint64).reshape(-1, words)[:, :2]).sum(axis=1, dtype=np.int32)
            columns = [*(pa.array([int(x)], pa.int32()) for x in (count.min(), count.max())), *(pa.array([f(sizes)], pa.int64()) for f in (min, max)), pa.array([np.array(nodes, np.int64).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([packed], pa.binary())], ["low", "high", "small", "large", "nodes", "fps"])

        nodes: list[int] = []
        sizes: list[int] = []
        held: list[bytes] = []
        for b in batches:
            for node, own, fp in zip(b["node"].to_pylist(), b["size"].to_pylist(), b["fp"].to_pylist(), strict=True):
                nodes.append(node)
                sizes.append(own)
                held.append(fp)
                if len(held) == size:
                    yield out(nodes, sizes, held)
                    nodes, sizes, held = [], [], []
        if held:
            yield out(nodes, sizes, held)

    kind = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(-math.log(similarity))) if similarity else F.lit(0)
    order = ["kind", "count", "fp", "node"]
    counted = distinct.select("node", "size", "fp", kind.cast("int").alias("kind"), count_bits("fp", min(bits, 128)).alias("count"))
    dealt = counted.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    return cut(dealt.select("node", "size", "fp").mapInArrow(run, "low int, high int, small long, large long, nodes binary, fps binary").withColumn("tile", F.monotonically_increasing_id()))


def count_bits(col: str, bits: int):
    """Population count of a binary column's first bits."""
    return sum(F.bit_count(F.conv(F.hex(F.substring(col, i, 4)), 16, 10).cast("long")) for i in range(1, bits // 8 + 1, 4))


def edges(distinct: DataFrame, radius: int = RADIUS, bits: int = BITS, exact: int | None = None, similarity: float = 0.0) -> DataFrame:
    """u, v (long): links that join the components of the different fingerprints of columns node (a number for each), size and fp.

    With a similarity, fingerprints need not meet whose sizes are further apart than that."""
    n = distinct.count()
    tiles = _tiles(distinct, n, bits, similarity)
    words, bucket = bits // 64, radius + 1
    spans = lambda low, high: F.explode(F.sequence(F.floor(low / bucket).cast("int"), F.floor(high / bucket).cast("int")))
    side = lambda tile, beyond: tiles.select(*(F.col(c).alias(f"{c}_{tile}") for c in ("tile", "low", "high", "small", "large")), spans(F.col("low") - beyond, F.col("high") + beyond).alias("bucket"))
    near = side("i", 0).join(side("j", radius), "bucket").filter((F.col("tile_i") <= F.col("tile_j")) & (F.col("low_i") - F.col("high_j") <= radius) & (F.col("low_j") - F.col("high_i") <= radius))
    least = similarity * (1 - 1e-9)
    near = near.filter((F.col("large_i") >= F.col("small_j") * least) & (F.col("large_j") >= F.col("small_i") * least)).select(F.col("tile_i").alias("i"), F.col("tile_j").alias("j")).distinct()
    sent = near.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j")))).join(tiles.select("tile", "nodes", "fps"), "tile")
    # a pair of tiles is much work and few bytes, so pairs are dealt out evenly
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(max(partitions, 3 * TILES), "i", "j")

    def meet(t: pa.Table) -> pa.Table:
        fps = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, words) for x in t["fps"]]
        u, v = links(fps[0], fps[1] if len(fps) > 1 else None, radius, exact)
        nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t["nodes"]])
        return pa.table([pa.array(nodes[k], pa.int64()) for k in (u, v)], names=["u", "v"])

    return sent.groupBy("i", "j").applyInArrow(meet, "u long, v long")


# --- components ---


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step on edges u > v: each node's neighbours (large: the greater ones; small: the lesser ones) are tied to the least."""
    if large:
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        return around.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
    tied = e.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(e: DataFrame) -> DataFrame:
    """u, v: each node that isn't the least of its component, with the least, for links u-v of any comparable type."""
    e = cut(e.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: d.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    before = mark(e)
    while before[0]:
        e = cut(_star(e, True))
        e = cut(_star(e, False))
        if (now := mark(e)) == before:
            break
        before = now
    return e


def _numbered(prints: DataFrame, by: str, *more) -> DataFrame:
    """least, node and more of each class `by`: links name classes by number, so that the rounds of stars move 16 bytes a link at any width."""
    return cut(prints.groupBy(by).agg(F.min("doc_id").alias("least"), *more).withColumn("node", F.monotonically_increasing_id()))


def _named(prints: DataFrame, by: str, classes: DataFrame, tied: DataFrame) -> DataFrame:
    """prints with root and component_id by the components (u, v) of nodes, which stand for classes `by`."""
    rooted = classes.join(tied.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(ids, "root").select(by, "root", "component_id"))
    return prints.join(named, by)


def classes(df: DataFrame, words: int = WORDS, radius: int = RADIUS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", exact: int | None = None, repeats: bool = True) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    prints = cut(fingerprints(df, words, bits, id_col, text_col, repeats))
    by_print = _numbered(prints, "fp")
    links_found = edges(by_print.select("node", F.lit(0).cast("long").alias("size"), "fp"), radius, bits, exact)
    return _named(prints, "fp", by_print, components(links_found)).select("doc_id", "fp", "component_id")


# --- near duplicates by Jaccard similarity ---


def differing(similarity: float) -> float:
    """The share of bits that are expected to differ between sets of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@cache
def most_differing(similarity: float, sizes: int = 40) -> float:
    """The largest share of bits expected to differ between sets of the similarity or more: small ones, where votes tie, are gone through."""
    odds = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    most = differing(similarity)
    for common in range(1, sizes + 1):
        rest = math.floor(common / similarity - common + 1e-9)
        for a in range(rest + 1):
            for b in range(min(a, rest - a) + 1):
                p = 0.0
                for k, at in enumerate(odds(common)):
                    x = sum(o for i, o in enumerate(odds(a)) if 2 * (k + i) > common + a)
                    y = sum(o for i, o in enumerate(odds(b)) if 2 * (k + i) > common + b)
                    p += at * (x + y - 2 * x * y)
                most = max(most, p)
    return most


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles that a fingerprint is made of."""
    w = text.encode().lower().split()
    n = max(1, len(w) - words + 1) if w else 0
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + words])) for i in range(n)), np.uint64, n))


def joined_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(place, place of the first of its component) of each later set of a component, linked by their Jaccard similarity."""
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, stops = of[order], np.cumsum(np.bincount(shingle))
    ends = np.cumsum(size)
    left, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        todo = [first] if left[first] else []
        left[first] = False
        while todo and left.any():
            a = todo.pop()
            own = shingle[ends[a] - size[a] : ends[a]]
            if not len(own):
                continue
            both = np.bincount(np.concatenate([holders[stops[x - 1] if x else 0 : stops[x]] for x in own.tolist()]), minlength=len(sets))
            near = np.flatnonzero(left & (both > 0) & (both >= similarity * (size + size[a] - both) - 1e-9))
            left[near] = False
            todo += near.tolist()
            out += [(x, first) for x in near.tolist()]
    return out


def confirmed(docs: DataFrame, classes: DataFrame, loose: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v: links by Jaccard similarity among the nodes of each component u-v of candidates; classes has the digest of a text of each node."""
    members = cut(loose.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(loose.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    wanted = members.join(classes.select("node", "digest"), "node")

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["node"], b["root"], pa.array([shingle_set(t, words).tobytes() for t in b["text"].to_pylist()], pa.binary())], ["node", "root", "shingles"])

    found = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text").join(wanted, "digest").dropDuplicates(["node"])
    sets = cut(arrow_map(found.select("node", "root", "text"), of, "node long, root long, shingles binary"))
    blocks = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int").alias("n"))
    dealt = sets.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    others = F.sequence(F.lit(0), F.col("n") - 1)
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("n") > 1, F.filter(others, lambda x: x != F.col("own"))).otherwise(others)))
    pairs = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")

    def meet(t: pa.Table) -> pa.Table:
        nodes = t["node"].to_numpy()
        at = joined_sets([np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()], similarity)
        return pa.table([pa.array([int(nodes[x[c]]) for x in at], pa.int64()) for c in range(2)], names=["u", "v"])

    # dealt by the pair: the join has dealt by root, which would leave all pairs of a large component in one task
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(partitions, "root", "i", "j").groupBy("root", "i", "j").applyInArrow(meet, "u long, v long")


def keep_first(df: DataFrame, words: int = WORDS, similarity: float = SIMILAR, bits: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, that of the least id, with all their columns; of rows of a component that repeat its id, one.

    Links are between texts whose shingle sets have the Jaccard similarity or more; SimHash gives the candidates.
    Rows without an id stay, since nothing tells which of them to keep."""
    p = most_differing(similarity)
    radius, exact = (math.floor(n * p + BEYOND * math.sqrt(n * p * (1 - p))) for n in (128, bits))
    docs = texts(df, id_col, text_col)

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        found = b["text"].to_pylist()
        fps, sizes, names = zip(*(sketch(t, words, bits, False) for t in found), strict=True)
        digests = [hashlib.md5(t.encode()).digest() for t in found]
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (fps, names, digests))], ["doc_id", "size", "fp", "shingles", "digest"])

    prints = cut(arrow_map(docs, of, "doc_id long, size long, fp binary, shingles binary, digest binary"))
    sets = _numbered(prints, "shingles", *(F.min(c).alias(c) for c in ("size", "fp", "digest")))
    loose = components(edges(sets.select("node", "size", "fp"), radius, bits, exact, similarity))
    found = _named(prints, "shingles", sets, components(confirmed(docs, sets, loose, words, similarity)))
    # an id may stand for different texts, so that rows are known by the digests of their texts as well
    kept_id, digest, times, own = (spare(df, x) for x in ("kept_id", "digest", "times", "own"))
    heads = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "root").agg(F.min("digest").alias(digest), F.count("*").alias("n"))
    kept = cut(heads.groupBy(F.col("doc_id").alias(kept_id), digest).agg(F.sum("n").alias(times)))
    keyed = df.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    rows = keyed.join(kept, (keyed[id_col].cast("long") == kept[kept_id]) & (keyed[own] == kept[digest])).drop(kept_id, digest)
    once = rows.filter(F.col(times) == 1).drop(times, own)
    again = rows.filter(F.col(times) > 1).dropDuplicates([id_col, own]).drop(times, own)
    return once.unionByName(again).unionByName(df.filter(F.col(id_col).isNull()))
