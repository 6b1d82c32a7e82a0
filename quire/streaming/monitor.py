"""The monitor over streams: state by key, the same columns as in batch; and event-time windows beside it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import monitor as M

OUT = "key string, seq long, category string, history long, window_full double, window_partial double, window_none double, global_full double, recent_none long, " + ", ".join(f"alert_{a} boolean" for a in M.ALERTS)
STATE = "window string, n_full long, n_judged long"
CODES = {"FULL": "F", "PARTIAL": "P", "NONE": "N", "MANUAL": "M"}


def step(window: deque, full: int, judged: int, category: str) -> tuple[dict, int, int]:
    """What one record adds: its row, and the counters after it. window holds the codes of the last records."""
    window.append(CODES[category])
    full, judged = full + (category == "FULL"), judged + (category != "MANUAL")
    in_window = sum(c != "M" for c in window)
    pct = lambda n, of: n / of * 100.0 if of else 0.0
    wf, wp, wn = (pct(sum(c == k for c in window), in_window) for k in "FPN")
    ever, recent, n = pct(full, judged), sum(c == "N" for c in list(window)[-M.STREAK :]), len(window)
    rules = {
        "drop": wf < ever - M.DROP, "critical": wn > M.CRITICAL, "streak": recent >= M.STREAK_FAILS,
        "very_low": wf < M.VERY_LOW and n >= M.VERY_LOW_LEAST, "improvement": wf > ever + M.IMPROVED_BY and wf > M.IMPROVED_FROM,
    }
    row = {"category": category, "history": n, "window_full": wf, "window_partial": wp, "window_none": wn, "global_full": ever, "recent_none": recent}
    return row | {f"alert_{k}": bool(n >= M.LEAST and v) for k, v in rules.items()}, full, judged


def monitored(stream: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Rows of (key, seq, category) with the monitor's columns; records of a micro-batch are taken by order, then seq."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        codes, full, judged = state.get if state.exists else ("", 0, 0)
        window = deque(codes, M.WINDOW)
        rows = pd.concat(list(batches)).sort_values(["order", "seq"], kind="stable")
        out = []
        for seq, category in zip(rows["seq"], rows["category"], strict=True):
            row, full, judged = step(window, full, judged, category)
            out.append({"key": k[0], "seq": seq} | row)
        state.update(("".join(window), full, judged))
        yield pd.DataFrame(out)

    typed = stream.select(F.col(key).cast("string").alias("key"), "seq", "category", F.col(order).alias("order"))
    return typed.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(outcomes: DataFrame, ts: str = "ts", kind: str = "tumbling", size: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Outcome percentages by event-time window, an extension: tumbling, sliding or session; late records count until the watermark passes."""
    frame = {"tumbling": lambda: F.window(ts, size), "sliding": lambda: F.window(ts, size, slide), "session": lambda: F.session_window(ts, size)}[kind]()
    c = F.col("category")
    judged = F.count_if(c != "MANUAL")
    rates = [M.percent(F.count_if(c == k), judged).alias(f"{k.lower()}_pct") for k in ("FULL", "PARTIAL", "NONE")]
    return outcomes.withWatermark(ts, late).groupBy(frame.alias("w")).agg(F.count("*").alias("n"), *rates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "full_pct", "partial_pct", "none_pct")


def retrained(corrections: DataFrame, store: str, rules: str, checkpoint: str):
    """Feedback loop: each micro-batch of corrections is appended to the store, and the rules are learned anew from all of it."""
    from quire.operators import feedback
    from quire.sources.sinks import snapshot

    def learn(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={n}")  # written again by the same number after a failure
        snapshot(feedback.promoted(batch.sparkSession.read.parquet(store)), rules)

    return corrections.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files_appearing(spark, folder: str, glob: str = "*") -> DataFrame:
    """A stream of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder).drop("content")


