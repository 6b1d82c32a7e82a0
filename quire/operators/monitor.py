"""Precision monitor in batch: outcome categories, count windows and drift alerts.

Windows count records, not time. The records of one key are a window of their own with `partition_by`; without it all
records follow each other, dealt into ranges of the first order column: each range gets the last records before it, and counts are
running sums within a range after what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ranges import at_or_below, quantiles

WINDOW, STREAK, LEAST, VERY_LOW_LEAST = 20, 5, 10, 15
# Percentages at which alerts are raised.
DROP, CRITICAL, STREAK_FAILS, VERY_LOW, IMPROVED_BY, IMPROVED_FROM = 15.0, 60.0, 4, 25.0, 10.0, 45.0
ALERTS = ("drop", "critical", "streak", "very_low", "improvement")


def category(matches: Column, manual: Column) -> Column:
    """MANUAL, FULL (all fields, also of none), PARTIAL or NONE."""
    return F.when(manual, "MANUAL").when(F.forall(matches, lambda x: x), "FULL").when(F.exists(matches, lambda x: x), "PARTIAL").otherwise("NONE")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * 100.0, F.lit(0.0))


def monitored(outcomes: DataFrame, order: list[str], partition_by: list[str] | None = None, category_col: str = "category") -> DataFrame:
    """Each record with window_full, window_partial, window_none, global_full (percentages) and its alerts as booleans."""
    if not partition_by and (value := _as_long(outcomes, order[0])) is not None:
        return _monitored(*_ranges(outcomes, value, order, category_col), order, category_col)
    return _monitored(outcomes, partition_by or [F.lit(0)], None, order, category_col)


def _as_long(df: DataFrame, column: str) -> Column | None:
    """A number that doesn't fall where the column rises; None for types that have none."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(column)
    if kind in ("timestamp", "date"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    return c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else None


def _ranges(outcomes: DataFrame, value: Column, order: list[str], category_col: str) -> tuple[DataFrame, list[str], tuple[str, str, str]]:
    """Records with their range, whether they are its own, and the counts of all ranges before it.

    A range also gets the WINDOW - 1 records before it. What passes through one task is that many records a range, and its totals."""
    parts = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = outcomes.withColumn("__part", at_or_below(value, quantiles(outcomes, value, parts)))
    c = F.col(category_col)
    totals = placed.groupBy("__part").agg(F.count_if(c == "FULL").alias("full"), F.count_if(c != "MANUAL").alias("judged"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"__{x}") for x in ("full", "judged")])
    down = Window.partitionBy("__part").orderBy(*[F.desc_nulls_last(x) for x in order])
    tails = placed.withColumn("__n", F.row_number().over(down)).filter(F.col("__n") < WINDOW).drop("__n")
    tails = tails.withColumn("__t", F.row_number().over(Window.orderBy("__part", *order)))
    wanted = tails.groupBy("__part").agg(F.min("__t").alias("first")).select(F.col("__part").alias("__to"), F.explode(F.sequence(F.lit(1), F.lit(WINDOW - 1))).alias("back"), "first")
    wanted = wanted.select("__to", (F.col("first") - F.col("back")).alias("__t"))
    carried = tails.join(wanted, "__t").withColumn("__part", F.col("__to")).drop("__t", "__to").withColumn("__own", F.lit(False))
    rows = placed.withColumn("__own", F.lit(True)).unionByName(carried).join(F.broadcast(totals), "__part")  # a row a range
    return rows, ["__part"], ("__own", "__full", "__judged")


def _monitored(outcomes: DataFrame, partition_by: list, ranged: tuple[str, str, str] | None, order: list[str], category_col: str) -> DataFrame:
    w = Window.partitionBy(*partition_by).orderBy(*order)
    last, streak, ever = w.rowsBetween(1 - WINDOW, 0), w.rowsBetween(1 - STREAK, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(category_col)
    n = lambda what, frame: F.count(F.when(what, 1)).over(frame)
    judged = c != "MANUAL"
    own, full_before, judged_before = (F.col(x) for x in ranged) if ranged else (F.lit(True), F.lit(0), F.lit(0))
    df = outcomes.withColumns(
        {
            "history": F.count(F.lit(1)).over(last),
            "window_full": percent(n(c == "FULL", last), n(judged, last)),
            "window_partial": percent(n(c == "PARTIAL", last), n(judged, last)),
            "window_none": percent(n(c == "NONE", last), n(judged, last)),
            "global_full": percent(full_before + n(own & (c == "FULL"), ever), judged_before + n(own & judged, ever)),
            "recent_none": n(c == "NONE", streak),
        }
    )
    if ranged:
        df = df.filter(own).drop(*partition_by, *ranged)
    return df.withColumns({f"alert_{k}": (F.col("history") >= LEAST) & v for k, v in alert_rules().items()})


def alert_rules() -> dict[str, Column]:
    full, none, ever, history = (F.col(x) for x in ("window_full", "window_none", "global_full", "history"))
    return {
        "drop": full < ever - DROP,
        "critical": none > CRITICAL,
        "streak": F.col("recent_none") >= STREAK_FAILS,
        "very_low": (full < VERY_LOW) & (history >= VERY_LOW_LEAST),
        "improvement": (full > ever + IMPROVED_BY) & (full > IMPROVED_FROM),
    }


def counters(outcomes: DataFrame, category_col: str = "category") -> DataFrame:
    """total, full, partial, none, manual and the percentages over all but manual: one row."""
    c = F.col(category_col)
    kinds = {k.lower(): F.count_if(c == k) for k in ("FULL", "PARTIAL", "NONE", "MANUAL")}
    df = outcomes.agg(F.count("*").alias("total"), *[v.alias(f"n_{k}") for k, v in kinds.items()])
    judged = F.col("n_full") + F.col("n_partial") + F.col("n_none")
    return df.withColumns({f"{k}_pct": percent(F.col(f"n_{k}"), judged) for k in ("full", "partial", "none")})


def per_field(outcomes: DataFrame, fields: list[str], matches_col: str = "matches") -> DataFrame:
    """field, ok, fail, precision: manual records count too, and surplus values or fields don't."""
    pairs = F.zip_with(F.array(*map(F.lit, fields)), F.col(matches_col), lambda f, m: F.struct(f.alias("field"), m.alias("ok")))
    rows = outcomes.select(F.explode(F.slice(pairs, F.lit(1), F.least(F.lit(len(fields)), F.size(matches_col)))).alias("x")).select("x.*")
    found = rows.groupBy("field").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"))
    return found.withColumn("precision", percent(F.col("ok"), F.col("ok") + F.col("fail")))


def summary(monitored_rows: DataFrame, order: list[str]) -> DataFrame:
    """The last record's rounded rates and its alerts: one row."""
    rates = ("window_full", "window_partial", "window_none", "global_full")
    last = monitored_rows.agg(F.max_by(F.struct("history", *rates, *[f"alert_{a}" for a in ALERTS]), F.struct(*order)).alias("x")).select("x.*")
    alerts = F.array_compact(F.array(*[F.when(F.col(f"alert_{a}"), a) for a in ALERTS]))
    return last.select("history", *[F.round(r, 1).alias(r) for r in rates], alerts.alias("alerts"))
