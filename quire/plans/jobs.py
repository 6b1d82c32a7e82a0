"""Jobs on the driver: a state machine with retries that resumes, and a batch of documents through an extractor."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.extract import Extractor
from quire.operators.resume import pending
from quire.sources.readers import done_ids

END = "__end__"


@dataclass
class State:
    """A handler of the context that gives the next state's name; None ends the machine."""

    handler: Callable[[dict], str | None]
    description: str = ""
    retries: int = 1


class Store:
    """The saved state of a machine as a one-row table on any file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, "state string, history string"

    def load(self) -> tuple[str | None, list[str]]:
        from quire.sources.readers import state

        row = state(self.spark, self.path, self.schema).first()
        return (row.state, json.loads(row.history)) if row else (None, [])

    def save(self, state: str, history: list[str]) -> None:
        self.spark.createDataFrame([(state, json.dumps(history))], self.schema).coalesce(1).write.mode("overwrite").parquet(self.path)


@dataclass
class StateMachine:
    states: Mapping[str, State]
    store: Store | None = None
    history: list[str] = field(default_factory=list)

    def run(self, context: dict | None = None, start: str | None = None) -> dict:
        """Runs from start, else from the saved state if it is known, else from the first; saves after each transition."""
        context = {} if context is None else context
        saved = self.store.load()[0] if self.store else None
        now = start or (saved if saved in self.states else next(iter(self.states)))
        while now in self.states:
            state = self.states[now]
            for attempt in range(max(1, state.retries)):
                try:
                    following = state.handler(context)
                    break
                except Exception:
                    if attempt + 1 >= state.retries:
                        raise
            self.history.append(now)
            now = following or END
            if self.store:
                self.store.save(now, self.history)
        return context


@dataclass
class Step:
    """A function of the results (with_context: of results and a context, which gives both); on_error: `skip` goes on without it, `stop` raises."""

    name: str
    fn: Callable
    on_error: str = "skip"
    with_context: bool = False


def run_batch(items: DataFrame, extractor: Extractor, done: DataFrame | None = None, steps: Sequence[Step] = (), text_col: str = "text", key: str | Column = "document_id", order: str = "seq", retry_failed: bool = False) -> DataFrame:
    """Results of the items that aren't done, each once: fields, validation, success, matches, and what the steps add.

    key: the column of the document's id, or an expression for it, which becomes document_id."""
    if isinstance(key, Column):
        items, key = items.withColumn("document_id", key), "document_id"
    results = extractor.process(pending(items, done, key, order, retry_failed=retry_failed), text_col)
    for step in steps:
        try:
            results = step.fn(results)
            results.schema  # noqa: B018  analysis errors belong to the step
        except Exception:
            if step.on_error == "stop":
                raise
    return results


def run_resumable(items: DataFrame, extractor: Extractor, results_path: str, done_path: str, batches: int = 8, steps: Sequence[Step] = (), context: dict | None = None, text_col: str = "text", key: str = "document_id", order: str = "seq") -> dict:
    """Runs items in batches by a hash of their key; each batch's results are written, then its keys, so that a job that dies repeats one batch at most.

    Gives total, succeeded, failed, skipped, and the context that steps with one pass from batch to batch. A batch that fails while it
    runs counts as failed and isn't marked as done, unless a step says `stop`: then its error is raised."""
    spark, context = items.sparkSession, {} if context is None else context
    summary = {"total": items.count(), "succeeded": 0, "failed": 0}
    todo = pending(items, done_ids(spark, done_path), key, order)
    for b in range(batches):
        own = todo.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        try:
            results = extractor.process(own, text_col)
            for step in steps:
                if step.with_context:
                    results, context = step.fn(results, context)
                else:
                    results = step.fn(results)
            path = f"{results_path}/batch={b}-{uuid.uuid4().hex}"
            results.write.parquet(path)
            written = spark.read.schema(results.schema).parquet(path)
            written.select(F.col(key).cast("string")).write.mode("append").text(done_path)
        except Exception:
            if any(step.on_error == "stop" for step in steps):
                raise
            summary["failed"] += own.count()
            continue
        row = written.agg(F.count_if("success").alias("ok"), F.count("*").alias("n")).first()
        summary["succeeded"] += row.ok
        summary["failed"] += row.n - row.ok
    return summary | {"skipped": summary["total"] - summary["succeeded"] - summary["failed"], "context": context}


def sample_documents(spark: SparkSession, n: int, kind: str = "id_card") -> DataFrame:
    """document_id, seq, text of invented documents, from integer arithmetic alone."""
    i = F.col("id")
    number = F.lpad((i * 7919 % 90_000_000 + 10_000_000).cast("string"), 8, "0")
    texts = {
        "id_card": F.concat(F.lit("REPUBLIC OF TESTLAND\nNATIONAL IDENTIFICATION CARD\nID Number: ID-"), number, F.lit("\nFull Name: TEST USER "), i.cast("string"), F.lit("\n")),
        "invoice": F.concat(F.lit("INVOICE INV-2026-"), F.lpad((i % 10_000).cast("string"), 4, "0"), F.lit("\nVendor: Example "), (i % 97).cast("string"), F.lit("\nTotal: $"), (i * 31 % 9_000 + 100).cast("string"), F.lit(".50\n")),
        "form": F.concat(F.lit("FORM-A"), F.lpad((i * 17 % 100_000).cast("string"), 5, "0"), F.lit("\nSignature: "), F.when(i % 3 == 0, "").otherwise("ABCDEFGH"), F.lit("\n")),
    }
    return spark.range(n).select(F.concat(F.lit("doc_"), i.cast("string")).alias("document_id"), i.alias("seq"), texts[kind].alias("text"))


def sample_batch(spark: SparkSession, n: int) -> DataFrame:
    """path, pages of an invented corpus: every other document is scanned, and a sixth of those badly."""
    i = F.col("id")
    scanned = i % 2 == 0
    conf = F.when(i % 12 == 0, 0.55).otherwise(0.95)
    page = F.struct(F.lit(1).alias("n"), (i % 1000).cast("int").alias("chars"), F.when(scanned, "rapid_ocr").otherwise("textlayer").alias("provider"), F.when(scanned, conf).otherwise(1.0).alias("conf"), F.concat(F.lit("page of "), i.cast("string")).alias("text"))
    return spark.range(n).select(F.concat(F.lit("doc_"), F.lpad(i.cast("string"), 6, "0"), F.lit(".pdf")).alias("path"), F.array(page).alias("pages"))
