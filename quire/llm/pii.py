"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Base entities (emails, IP addresses, cards, phones) are found in whole texts, in time linear
in their length. Terms that disclose them are learnt from the whole corpus: with c a kind of
entity and t a word, p(c|t) is the share of t's occurrences that stand within WINDOW words of
an entity of kind c, and the disclosure of c by t is PMI(c;t) / IC(c) = 1 + ln p(c|t) / -ln p(c).
A single entity (a value of a kind) is judged likewise, with its own share of the words.
A word that stands near them in SUPPORT different texts or more and whose disclosure reaches
GENERALISE is generalised to a placeholder, from REMOVE on it is removed; both only in
documents that hold an entity of that kind, or that entity, so that documents without stay as they are.

Different texts are counted, each once for each value in it, so that exact copies of one document
prove nothing; near copies count. How many values a word stands near doesn't matter.
Two small tables are read by the driver and sent to the executors, the words near enough
different texts and those of them that disclose: both only up to TERMS rows, which is
checked; beyond that, joins on the word do the same.

Cases: null and empty texts have no spans; repeated rows and ids give repeated rows; an empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut, pieces, spare, texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, GENERALISE, REMOVE, TERMS = 12, 5, 0.8, 0.95, 200_000
#: Contexts that a task sums up in memory before it passes them on.
HELD = 100_000

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]")
_digit = re.compile(r"[0-9]")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\W\d_]{2,}")
_not_digit = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points by kind, then start: leftmost matches that don't overlap in a kind, failing ones dropped.

    An email is found from its @, and an address from the start of a run of digits, which
    gives the matches of the patterns without trying every character of a long run."""
    out, last = [], 0
    if "@" in text:
        for m in _domain.finditer(text):
            at = start = m.start()
            while start > last and _local.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    if _digit.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _phone.finditer(text) if 9 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


def words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, lower-case word) outside the spans."""
    taken, out, i = sorted((s, e) for _, s, e in spans), [], 0
    ends: list[tuple[int, int]] = []  # the spans merged
    for s, e in taken:
        if ends and s <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(e, ends[-1][1]))
        else:
            ends.append((s, e))
    for m in _word.finditer(text):
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if i == len(ends) or m.end() <= ends[i][0]:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def hashed(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> tuple[dict[tuple[int, str], Counter], Counter]:
    """Of each (kind, word near an entity of it): how many occurrences stand near each value, and how many near any.

    An occurrence counts once a kind and once a value, however many entities it stands near."""
    found = words(text, spans)
    starts = [w[0] for w in found]
    values: dict[tuple[int, str], Counter] = {}
    seen: set[tuple[int, int]] = set()
    near: set[tuple[int, str, int]] = set()
    times: Counter = Counter()
    for kind, s, e in spans:
        value, at = text[s:e].lower(), bisect_left(starts, s)
        for i in range(max(0, at - window), min(len(found), at + window)):
            key = (kind, found[i][2])
            if (kind, value, i) not in near:
                near.add((kind, value, i))
                values.setdefault(key, Counter())[value] += 1
            if (kind, i) not in seen:
                seen.add((kind, i))
                times[key] += 1
    return values, times


def _near(docs: DataFrame, window: int) -> DataFrame:
    """kind, term, value and text (hashes), n and n_value: occurrences near an entity of the kind (at one of a text's values) and near the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate(kinds)], ["kind", "term", "value", "text", "n", "n_value"])
            held.clear()
            return batch

        for b in pieces(batches):
            for text in b["text"].to_pylist():
                if spans := base_spans(text):
                    values, times = contexts(text, spans, window)
                    own, number = hashed(text), {v: hashed(v) for seen in values.values() for v in seen}
                    for key, seen in values.items():
                        left = times[key]
                        for v in sorted(seen):
                            held.append((*key, number[v], own, left, seen[v]))
                            left = 0
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "kind int, term string, value long, text long, n long, n_value long")


def _counts(docs: DataFrame, wanted: set[str] | None) -> DataFrame:
    """term, n: occurrences in the corpus of the wanted words (None: of all); a null term has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = Counter(), 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
            held.clear()
            return batch

        for b in pieces(batches):
            for text in b["text"].to_pylist():
                found = [w.lower() for w in _word.findall(text)]
                total += len(found)
                held.update(found if wanted is None else filter(wanted.__contains__, found))
                if len(held) > HELD and wanted is None:
                    yield out()
        held[None] = total
        yield out()

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, most: int = TERMS) -> DataFrame:
    """kind, term, value, disclosure of the words whose disclosure reaches the threshold, of a kind (value is null) or of one of its values."""
    by_text = _near(docs, window).groupBy("kind", "term", "value", "text").agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"))
    by_value = cut(by_text.groupBy("kind", "term", "value").agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.count("*").alias("n_texts")))
    near = by_value.groupBy("kind", "term").agg(F.sum("n").alias("n_near"), F.sum("n_texts").alias("n_texts"))
    in_kind = by_value.groupBy("kind").agg(F.sum("n").alias("n_all_near"))  # 4 rows at most
    in_value = by_value.groupBy("kind", "value").agg(F.sum("n_value").alias("n_all_near"))
    often = cut(near.filter(F.col("n_texts") >= support).withColumn("value", F.lit(None).cast("long")))
    single = by_value.filter(F.col("n_texts") >= support).select("kind", "term", "value", F.col("n_value").alias("n_near"))
    wanted = often.select("term").distinct().limit(most + 1).collect()  # a word often near a value is often near its kind
    counts = cut(_counts(docs, {r.term for r in wanted} if len(wanted) <= most else None))
    total = counts.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))  # one row
    p = F.least(F.lit(1.0), F.col("n_near") / F.col("n"))
    ic = -F.ln(F.col("n_all_near") / F.col("n_all"))
    columns = ["kind", "term", "value", "n_near", "n_all_near"]
    judged = often.join(F.broadcast(in_kind), "kind").select(columns).unionByName(single.join(in_value, ["kind", "value"]).select(columns))
    return (
        judged.join(counts, "term").join(F.broadcast(total))
        .filter((F.col("n_all_near") < F.col("n_all")) & (F.col("n") > 0))
        .select("kind", "term", "value", (1 + F.ln(p) / ic).alias("disclosure")).filter(F.col("disclosure") >= generalise)
    )


def _term_spans(text: str, spans: list[tuple[int, int, int]], told: dict[str, list[tuple[int, int | None, float]]]) -> list[tuple[int, int, float]]:
    """(start, end, disclosure) of words that disclose a kind or an entity that the text holds."""
    here, out = {(k, None) for k, _, _ in spans}, []
    if told:
        here |= {(k, hashed(text[s:e].lower())) for k, s, e in spans}
    for s, e, w in words(text, spans) if spans and told else ():
        if (d := max((d for k, v, d in told.get(w, ()) if (k, v) in here), default=None)) is not None:
            out.append((s, e, d))
    return out


def _with_terms(docs: DataFrame, terms: DataFrame, most: int) -> tuple[DataFrame, dict | None]:
    """The disclosing words as a dictionary if there are few enough, else beside each document that holds any."""
    terms = cut(terms)
    found = terms.limit(most + 1).collect()
    if len(found) <= most:
        told: dict[str, list[tuple[int, int | None, float]]] = {}
        for r in found:
            told.setdefault(r.term, []).append((r.kind, r.value, r.disclosure))
        return docs, told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [(i, w) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) if (s := base_spans(t)) for w in {x[2] for x in words(t, s)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "term"])

    in_docs = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, term string").join(terms, "term").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("term", "kind", "value", "disclosure")).alias("told"))
    return docs.join(in_docs, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id"), None


def _mapped(df: DataFrame, of_text, schema: str, names: list[str], id_col: str, text_col: str, **settings) -> DataFrame:
    docs = texts(df, id_col, text_col)
    most = settings.pop("most", TERMS)
    docs, told = _with_terms(docs, disclosing(docs, most=most, **settings), most)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch["told"].to_pylist() if told is None else [None] * batch.num_rows
        rows = []
        for doc_id, text, mine in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), own, strict=True):
            known = told if told is not None else _known(mine)
            spans = base_spans(text)
            rows.append((doc_id, *of_text(text, spans, _term_spans(text, spans, known))))
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])
    return arrow_map(docs, of, schema)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: spans are kind:start:end, comma-joined, those of terms last."""

    def row(text, spans, terms):
        n, base = Counter(k for k, _, _ in spans), [f"{KINDS[k]}:{s}:{e}" for k, s, e in spans]
        return *(n[k] for k in range(4)), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join([*base, *(f"term:{s}:{e}" for s, e, _ in terms)]), len(terms)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"]
    return _mapped(df, row, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names), names, id_col, text_col, **settings)


def cleaned(text: str, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """The text with entities replaced by their kind's name, disclosing words by [TERM] or, from `remove` on, by nothing."""
    cuts = sorted([(s, e, f"[{KINDS[k].upper()}]") for k, s, e in spans] + [(s, e, "" if d >= remove else "[TERM]") for s, e, d in terms])
    out, at = [], 0
    for s, e, put in cuts:
        if s >= at:  # of entities that overlap, the first stands for both
            out += [text[at:s], put]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, most: int = TERMS, **settings) -> DataFrame:
    """df's rows and columns with cleaned texts; null texts stay null."""
    docs, told = _with_terms(texts(df, id_col, text_col), disclosing(texts(df, id_col, text_col), most=most, **settings), most)
    rows, own, columns = df, None, df.columns
    if told is None:
        own, of_id = spare(df, "told"), spare(df, "of_id")
        in_docs = docs.select(F.col("doc_id").alias(of_id), F.col("told").alias(own)).filter(F.col(own).isNotNull()).dropDuplicates([of_id])
        rows = df.join(in_docs, df[id_col].cast("long").eqNullSafe(in_docs[of_id]), "left").drop(of_id)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine, out = batch[own].to_pylist() if own else [None] * batch.num_rows, []
        for text, x in zip(batch[text_col].to_pylist(), mine, strict=True):
            known = told if told is not None else _known(x)
            spans = base_spans(text) if text else []
            out.append(cleaned(text, spans, _term_spans(text, spans, known), remove) if spans else text)
        at = batch.schema.get_field_index(text_col)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
        return batch.select(columns)

    return arrow_map(rows, of, df.schema)


def _known(told: list[dict] | None) -> dict[str, list[tuple[int, int | None, float]]]:
    known: dict[str, list[tuple[int, int | None, float]]] = {}
    for x in told or ():
        known.setdefault(x["term"], []).append((x["kind"], x["value"], x["disclosure"]))
    return known
