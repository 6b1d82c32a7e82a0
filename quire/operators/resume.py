"""Batches that can be resumed: what is done is left out by an anti-join, and so are repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame | None, key: str = "document_id", order: str = "seq", limit: int | None = None, retry_failed: bool = False) -> DataFrame:
    """The first row of each key that isn't done yet, in order if there is a limit.

    done: rows with the key and, for retry_failed, `success`; failed ones are then tried again."""
    first = items.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
    if done is not None:
        if retry_failed:
            done = done.filter("success")
        first = first.join(done.select(key).distinct(), key, "left_anti")
    return first.orderBy(order).limit(limit) if limit is not None else first


def summary(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """total, processed, succeeded, failed, skipped: one row. outcomes: a row with `success` for each document that was processed."""
    total = items.agg(F.count("*").alias("total"))
    ran = outcomes.agg(F.count("*").alias("processed"), F.count_if("success").alias("succeeded"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"))
    both = total.join(F.broadcast(ran))  # one row each
    return both.withColumn("skipped", F.col("total") - F.col("processed"))


def checkpoint(done: DataFrame, key: str = "document_id") -> DataFrame:
    """Sorted ids as text, each once."""
    return done.select(F.col(key).cast("string").alias(key)).distinct().orderBy(key)
