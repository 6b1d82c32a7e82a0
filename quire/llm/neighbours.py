"""Approximate nearest neighbours by cosine: a forest of random-projection trees, then exact ranks.

Trees are grown on a bounded sample (SAMPLE rows or about so): a node's direction joins two
random points of it and its threshold is the median, so that dense regions get as many leaves
as they have points. Leaves shrink with the table up to the sample's resolution. Every vector is
put into one leaf of each tree. A query walks all trees with one priority queue, taking the branch
of the least regret next, until its leaves hold SEARCH candidates or the share of the table that the
measured recall asks for, whichever is more. Each leaf's queries meet its vectors in one task, which
hands on the best of each query by exact cosine in double precision.

Recall is measured on each table: HELD_OUT of its queries are compared with every row, which is linear,
and the share is the least at which their walks meet AIM of the true neighbours. Where that would be a
whole table's worth of candidates, all leaves of a single tree are read instead, and the result is exact.

The best of the sample are candidates of each query, too, and a leaf hands on only what is no worse than
all of them: nothing else can be in the result.

Equal vectors are one query, and a task passes on only the least ids among equal vectors, as many
as can appear in a result: that loses nothing, since ties go to the smaller id, and keeps a very
common vector from filling a leaf.

Cases: rows whose id or vector is null, or whose vector is zero, has a null or non-finite part or
another length than most, take no part; rows that repeat an id count once; with SEARCH candidates
or fewer the result is exact; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded, pieces

TREES, SAMPLE, LEAF, SEARCH, SPLIT_LEAST = 3, 20_000, 192, 6_000, 8
#: Queries that recall is measured on, and the recall wanted of them: 3 deviations of their mean above 0.9.
HELD_OUT, AIM = 256, 0.95
#: Vectors handled at a time, and vectors of a leaf that meet its queries in one task, about.
ROWS, PART = 4096, 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Arrays by node: direction, threshold, children (negative: leaf number, complemented), and the sample's share in each leaf."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        direction, threshold, children, shares = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    d = a - b
                    if (norm := np.sqrt(d @ d)) < 1e-9:
                        continue
                    at = x[rows] @ (d / norm)
                    middle = float(np.median(at))
                    right = at > middle
                    if not 0.2 < right.mean() < 0.8:
                        continue  # many equal points
                    k = len(threshold)
                    direction.append(d / norm)
                    threshold.append(middle)
                    children.append(None)
                    children[k] = (grow(rows[~right]), grow(rows[right]))
                    return k
            shares.append(len(rows) / len(x))
            return -len(shares)

        self.root = grow(np.arange(len(x))) if len(x) else -1
        self.shares = np.array(shares or [1.0])
        self.direction = np.array(direction).reshape(len(direction), x.shape[1])
        self.threshold, self.children = np.array(threshold), np.array(children, np.int64).reshape(-1, 2)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), self.root, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            right = (x[inner] * self.direction[n]).sum(axis=1) > self.threshold[n]
            at[inner] = self.children[n, right.astype(np.int64)]
        return -at - 1


class Forest:
    def __init__(self, x: np.ndarray, leaf: int, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(x, leaf, rng) for _ in range(trees)]

    def search(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in order of regret until they hold a share of the rows, leaves of all trees counted."""
        margins = [t.direction @ q - t.threshold for t in self.trees]
        queue = [(0.0, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        out, held = [], 0.0
        while queue and held < share:
            regret, i, node = heapq.heappop(queue)
            tree = self.trees[i]
            while node >= 0:
                m = margins[i][node]
                near, far = tree.children[node][::-1] if m > 0 else tree.children[node]
                heapq.heappush(queue, (max(regret, abs(m)), i, far))
                node = near
            out.append((i, -node - 1))
            held += tree.shares[-node - 1]
        return out

    def needed(self, q: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The share that `search` is to be given for q to meet each of the vectors found."""
        at, shares, held = [t.leaves(found) for t in self.trees], np.full(len(found), np.inf), 0.0
        for t, leaf in self.search(q, np.inf):
            held += self.trees[t].shares[leaf]
            shares = np.where(np.isinf(shares) & (at[t] == leaf), held, shares)
            if not np.isinf(shares).any():
                break
        return shares


def usable(col: Column) -> Column:
    finite = F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return col.isNotNull() & finite & F.exists(col, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _keys(x: np.ndarray) -> list[bytes]:
    """Of each row a 128-bit key; 0 and -0 are the same."""
    x = np.ascontiguousarray(x + 0.0)
    return [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]


def _wanted(rows: DataFrame, forest: Forest, k: int, real: type) -> float:
    """The least share at which held-out queries meet AIM of their true neighbours, which a scan of all rows tells."""
    held = rows.filter("asks").select("vec_id", "v").orderBy(F.xxhash64(F.lit("held out"), "vec_id"), "vec_id").limit(HELD_OUT).collect()
    if not held:
        return 0.0
    own, q = np.array([r.vec_id for r in held]), unit(np.array([r.v for r in held], real))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a task's rows for each query."""
        best: list[dict[int, tuple[float, bytes]]] = [{} for _ in held]
        for b in pieces(batches, ROWS):
            x, ids = _matrix(b["v"]).astype(real), b["vec_id"].to_numpy(zero_copy_only=False)
            for i, row in enumerate(q @ unit(x).T):
                some = np.flatnonzero(row >= min((s for s, _ in best[i].values()), default=-2.0)) if len(best[i]) >= k else np.arange(len(row))
                for j in some[np.lexsort((ids[some], -row[some]))].tolist():
                    if ids[j] != own[i]:
                        best[i].setdefault(int(ids[j]), (float(row[j]), x[j].tobytes()))
                        if len(best[i]) > 2 * k:
                            break
                best[i] = dict(sorted(best[i].items(), key=lambda e: (-e[1][0], e[0]))[:k])
        out = [(i, v, s, x) for i, found in enumerate(best) for v, (s, x) in found.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.binary()), strict=True)], ["q", "vec_id", "score", "x"])

    best = rows.select("vec_id", "v").mapInArrow(scan, "q int, vec_id long, score double, x binary").dropDuplicates(["q", "vec_id"])
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k)
    true: dict[int, list[bytes]] = {}
    for r in best.select("q", "x").collect():
        true.setdefault(r.q, []).append(bytes(r.x))
    needed = [forest.needed(q[i], unit(np.frombuffer(b"".join(found), real).reshape(len(found), -1))) for i, found in true.items()]
    if not needed:
        return 0.0
    shares = np.sort(np.concatenate(needed))
    return float(shares[int(np.ceil(AIM * len(shares))) - 1])


def nearest(df: DataFrame, queries: Column, k: int = 5, trees: int = TREES, sample: int = SAMPLE, search: int = SEARCH, part: int = PART, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of df for which `queries` (of df's columns) holds."""
    kind = "float" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = bounded(df).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (sizes.d, sizes.n) if sizes else (1, 0)
    rows = rows.filter(F.size("v") == dim)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("forest"), "vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)) + 1))
    seen = picked.select("vec_id", "v").orderBy(F.xxhash64(F.lit("forest"), "vec_id"), "vec_id", "v").limit(2 * sample).collect()
    seen.sort(key=lambda r: (r.vec_id, r.v))
    real = np.float32 if kind == "float" else np.float64
    own = list({r.vec_id: r for r in seen}.values())
    seeds, seed_ids = unit(np.array([r.v for r in own], real)) if own else np.zeros((0, dim)), np.array([r.vec_id for r in own], np.int64)
    points = unit(np.array([r.v for r in seen])) if seen else np.zeros((0, dim))
    points = np.unique(points, axis=0)  # a common vector must not make leaves that hold nothing else
    forest = Forest(points, max(SPLIT_LEAST, round(LEAF * len(points) / max(1, n))), trees)
    most = k + 1
    share = trees * search / max(1, n) / 3
    if share < 1:
        share = max(share, _wanted(rows, forest, k, real))
    if share >= 1:
        forest.trees, share = forest.trees[:1], np.inf  # all leaves of one tree are all rows

    # a leaf of more than PART vectors is met in parts, each by all of its queries, so that no task holds a whole one
    parts = [np.maximum(1, np.ceil(t.shares * n / part)).astype(np.int64) for t in forest.trees]

    def packed(b: pa.RecordBatch) -> np.ndarray:
        return _matrix(b["v"]).astype(real)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its leaf of each tree; of equal ones the least ids that a batch adds."""
        least: dict[bytes, list[int]] = {}
        for b in pieces(batches, ROWS):
            x, ids = packed(b), b["vec_id"].to_numpy(zero_copy_only=False)
            keys, keep = _keys(x), []
            for i in np.argsort(ids, kind="stable").tolist():
                known = least.setdefault(keys[i], [])
                v = int(ids[i])
                if v not in known and (len(known) < most or v < known[-1]):
                    known.append(v)
                    known.sort()
                    del known[most:]
                    keep.append(i)
            if keep:
                x, ids = x[keep], ids[keep]
                u = unit(x)
                vectors = pa.array([r.tobytes() for r in x], pa.binary())
                for t, tree in enumerate(forest.trees):
                    leaf = tree.leaves(u)
                    own = np.abs(ids) % parts[t][leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(ids), vectors], ["tree", "leaf", "part", "vec_id", "v"])

    def sown(u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Of each query the places and scores of the best of the sample, and the score that a candidate must reach."""
        for i in range(0, len(u), 256):
            for q, row in zip(u[i : i + 256], u[i : i + 256] @ seeds.T, strict=True):
                best = np.argpartition(row, -most)[-most:] if len(row) > most else np.arange(len(row))
                yield best, (seeds[best] * q).sum(axis=1), float(row[best].min()) if len(best) == most else -2.0

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, ROWS):
            x = packed(b)
            out = [(key, int(v), float(s)) for key, (best, scores, _) in zip(_keys(x), sown(unit(x)), strict=True) for v, s in zip(seed_ids[best], scores, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.float64()))], ["key", "vec_id", "score"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves that each different query vector looks at."""
        done: set[bytes] = set()
        for b in pieces(batches, ROWS):
            x = packed(b)
            out = []
            us = unit(x)
            for key, r, u, (_, _, low) in zip(_keys(x), x, us, sown(us), strict=True):
                if key not in done:
                    done.add(key)
                    out += [(t, leaf, p, key, r.tobytes(), low) for t, leaf in forest.search(u, share) for p in range(int(parts[t][leaf]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int32()] * 3, pa.binary(), pa.binary(), pa.float64()), strict=True)], ["tree", "leaf", "part", "key", "q", "low"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, ROWS):
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(_keys(packed(b)), pa.binary())], ["query_id", "key"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of a leaf's vectors for each of its queries."""
        schema = pa.schema([("key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())])
        asked = dict(zip(left["key"].to_pylist(), left["q"].to_pylist(), strict=True))
        lows = dict(zip(left["key"].to_pylist(), left["low"].to_pylist(), strict=True))
        if not asked or not right.num_rows:
            return schema.empty_table()
        ids, first = np.unique(right["vec_id"].to_numpy(), return_index=True)
        stored = right["v"].to_pylist()
        x = unit(np.frombuffer(b"".join(stored[i] for i in first), real).reshape(len(ids), -1))
        keys = list(asked)
        q = unit(np.frombuffer(b"".join(asked.values()), real).reshape(len(keys), -1))
        out: list[tuple[bytes, int, float]] = []
        for i in range(0, len(q), 256):
            rough = q[i : i + 256] @ x.T
            for key, u, row in zip(keys[i : i + 256], q[i : i + 256], rough, strict=True):
                cut_at = np.partition(row, -most)[-most] if len(row) > most else -2.0
                near = np.flatnonzero(row >= max(cut_at, lows[key]) - 1e-9)
                exact = (x[near] * u).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                order = np.lexsort((ids[near], -exact))[:most]
                out += [(key, int(ids[near[j]]), float(exact[j])) for j in order]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(schema.types)], schema=schema)

    asking = rows.filter("asks").select("vec_id", "v")
    placed = rows.select("vec_id", "v").mapInArrow(place, "tree int, leaf int, part int, vec_id long, v binary")
    probes = asking.mapInArrow(probe, "tree int, leaf int, part int, key binary, q binary, low double")
    met = probes.groupBy("tree", "leaf", "part").cogroup(placed.groupBy("tree", "leaf", "part")).applyInArrow(meet, "key binary, vec_id long, score double")
    met = met.unionByName(asking.mapInArrow(seed, "key binary, vec_id long, score double"))
    best = met.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    by_key = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("n", F.row_number().over(by_key)).filter(F.col("n") <= most).drop("n")
    names = asking.mapInArrow(name, "query_id long, key binary").distinct()
    answers = names.join(best, "key").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
