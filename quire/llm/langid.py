"""Language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 over the bytes of a window, a rectifier, the maximum over all
positions, and a softmax over the languages. It is trained here in numpy by Adam, on windows
of labelled texts; since bytes are one-hot, a filter is a table of weights by place and byte,
and at prediction a row gathered by byte pair holds what every filter needs.

Every text is lower-cased and cut whole into windows of WINDOW bytes that overlap by the widest
filter less one; its languages' scores are the means over its windows, weighted by their bytes.

The sample is bounded by parameters: PER_LANGUAGE rows of a language, those of the least hash of
doc_id and text, however often an id repeats, and WINDOWS windows of each. Only these windows reach the driver.

Cases: a null text, an empty one or one without a letter is `und` with score 0; so is every
text if there is no labelled row; labels of rows with such texts teach nothing; ties go to the
language that sorts first; repeated rows are predicted alike; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, bounded, first_rows, pieces, texts

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
PER_LANGUAGE, WINDOWS, STEPS, BATCH, RATE = 400, 4, 240, 96, 0.01
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
#: Windows that are convolved at a time: their arrays stay in a core's cache.
BLOCK = 32

#: What may be a letter: numerals such as a half or a circled one pass and are told by their category.
_letter = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in _letter.finditer(text))


def windows(text: str) -> np.ndarray:
    """All windows of a text, one a row, the last filled with zeros."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-(len(data) - WINDOW + STRIDE) // STRIDE)) if len(data) > WINDOW else 1
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Network:
    """tables[w][j] gives the weights of width w's filters for a byte at place j."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        for t in self.tables.values():
            t[:, 0] = 0  # filling

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on the cross entropy; languages are drawn equally often."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by_language = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            rows = np.array([rng.choice(by_language[k]) for k in rng.integers(0, len(by_language), BATCH)])
            b, target = x[rows], y[rows]
            pooled, at = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = self.tables[w][0][b[:, :n]]
                for j in range(1, w):
                    z += self.tables[w][j][b[:, j : n + j]]
                top = z.argmax(axis=1)
                at.append(top)
                pooled.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + self.bias[w])
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ self.out + self.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), target] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (raw > 0)
            grads, bias_grads = [], []
            for i, w in enumerate(WIDTHS):
                g, part = np.zeros_like(self.tables[w]), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (b[np.arange(BATCH)[:, None], at[i] + j], np.arange(FILTERS)[None]), part)
                g[:, 0] = 0
                grads.append(g)
                bias_grads.append(part.sum(0))
            rate = RATE * (1 if step < 0.7 * steps else 0.2)
            for q, g, m, v in zip(params, [*grads, *bias_grads, hidden.T @ p, p.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gathered(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte pair what widths 2 and 3 need, then width 4's first and last half; of each byte width 3's last place."""
        if not hasattr(self, "pairs"):
            t2, t3, t4 = (self.tables[w] for w in WIDTHS)
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            self.pairs = np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3])], 1)
            self.last = np.ascontiguousarray(t3[2])
        return self.pairs, self.last

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window the languages' probabilities."""
        pairs, last = self._gathered()
        out = np.empty((len(x), len(self.languages)))
        f = FILTERS

        def most(z: np.ndarray) -> np.ndarray:
            while (n := z.shape[1]) > 4:  # halves, so that each step is over long rows
                z = np.maximum(z[:, : (n + 1) // 2], z[:, n // 2 :])
            return z.max(axis=1)

        for i in range(0, len(x), BLOCK):
            b = x[i : i + BLOCK].astype(np.intp)
            rows = pairs[(b[:, :-1] << 8) | b[:, 1:]]
            pooled = [most(rows[..., :f]), most(rows[:, :-1, f : 2 * f] + last[b[:, 2:]]), most(rows[:, :-2, 2 * f : 3 * f] + rows[:, 2:, 3 * f :])]
            hidden = np.maximum(np.concatenate([p + self.bias[w] for p, w in zip(pooled, WIDTHS, strict=True)], 1), 0)
            logits = (hidden @ self.out + self.out_bias).astype(np.float64)
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[i : i + BLOCK] = p / p.sum(1, keepdims=True)
        return out

    def predict(self, some: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        told = [has_letter(t) for t in some] if self.languages else [False] * len(some)
        cut = [windows(t) for t, ok in zip(some, told, strict=True) if ok]
        out: list[tuple[str, float]] = []
        p = self.probabilities(np.concatenate(cut)) if cut else None
        at = k = 0
        for t, ok in zip(some, told, strict=True):
            if not ok:
                out.append((UNKNOWN, 0.0))
                continue
            n = len(cut[k])
            k += 1
            weight = np.full(n, float(STRIDE))
            weight[-1] = max(1.0, len(t.lower().encode()) - (n - 1) * STRIDE)
            mean = weight @ p[at : at + n] / weight.sum()
            at += n
            best = int(mean.argmax())
            out.append((self.languages[best], min(1.0, float(mean[best]))))
        return out


def sample(df: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their languages' numbers from the labelled rows for which `usable` holds."""
    labelled = df.filter(usable).filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = bounded(labelled).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = first_rows(rows, "lang", F.xxhash64("doc_id", "text"), ["doc_id", "text"], per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for doc_id, text, lang in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                w = windows(text)
                for i in sorted({round(i * (len(w) - 1) / (WINDOWS - 1)) for i in range(WINDOWS)}):
                    rows.append((lang, doc_id, i, w[i].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["lang", "doc_id", "i", "window"])

    rows = sorted((r.lang, r.doc_id, r.i, bytes(r.window)) for r in found.mapInArrow(run, "lang string, doc_id long, i int, window binary").collect())
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, WINDOW)
    return languages, x, np.array([number[r[0]] for r in rows], np.int64)


def fit(df: DataFrame, usable: Column, **columns) -> Network:
    """A network trained on the sample of the usable rows."""
    languages, x, y = sample(df, usable, **columns)
    net = Network(languages)
    if len(languages) > 1:
        net.train(x, y)
    return net


_nets: dict[bytes, Network] = {}


def _unpacked(packed: bytes) -> Network:
    """The network; a worker unfolds its tables once."""
    if packed not in _nets:
        _nets.clear()
        _nets[packed] = pickle.loads(packed)
    return _nets[packed]


def identify(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    packed = pickle.dumps(net)

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        got = _unpacked(packed).predict(b["text"].to_pylist())
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(texts(df, id_col, text_col), of, "doc_id long, lang_pred string, score double")


def kept(df: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text has a language; no exchange.

    A text of a window's bytes or more needs a score of `least`; a shorter one says too little to be rejected by it."""
    packed = pickle.dumps(net)

    def of(b: pa.RecordBatch) -> pa.RecordBatch | None:
        some = [t or "" for t in b[text_col].to_pylist()]
        got = _unpacked(packed).predict(some)
        b = b.filter(pa.array([lang != UNKNOWN and (score >= least or len(t.encode()) < WINDOW) for t, (lang, score) in zip(some, got, strict=True)]))
        return b if b.num_rows else None

    return arrow_map(df, of, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents that teach nothing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
