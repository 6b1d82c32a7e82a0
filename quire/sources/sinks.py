"""Sinks: appended results, snapshots, cell updates, queue moves and the HTML report."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import report
from quire.sources.readers import column_index


def append_results(results: DataFrame, path: str) -> None:
    """Result lines without the raw text."""
    results.drop("raw_text").write.mode("append").json(path)


def write_batch(batch: DataFrame, path: str, done_path: str, key: str = "path") -> None:
    """Documents, then their keys; after a crash between the two, `deduplicated` reads each document once."""
    batch.write.mode("append").json(path)
    batch.select(key).write.mode("append").text(done_path)


def write_launched(results: DataFrame, path: str) -> None:
    """One file of JSON: what succeeded (file, success, fields, validation, provider_chain) and what didn't (file, error), in one list, in order."""
    columns = [c for c in ("file", "success", "fields", "validation", "provider_chain", "error") if c in results.columns]
    rows = results.orderBy("seq") if "seq" in results.columns else results
    rows.select(*columns).coalesce(1).write.mode("overwrite").json(path)


def deduplicated(batch: DataFrame, key: str = "path") -> DataFrame:
    return batch.dropDuplicates([key])


def swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What write() puts beside a folder takes its place when it is whole; the folder's own content may be what it reads."""
    jvm = spark._jvm
    beside, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{x}") for x in ("new", "old"))
    at = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    write(beside.toString())
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(beside, at):
        raise OSError(f"{beside} can't be moved")
    fs.delete(old, True)


def snapshot(df: DataFrame, path: str) -> None:
    """Replaces a table of learned state, rules, patterns or processed ids, which df may have been read from."""
    swapped(df.sparkSession, path, lambda beside: df.write.mode("overwrite").parquet(beside))


def clear(df: DataFrame, path: str) -> None:
    snapshot(df.limit(0), path)


def upserted(sheet: DataFrame, updates: DataFrame) -> DataFrame:
    """sheet (row_number, cells) with updates (row_number, letter, value), grown with '' where an update lies outside.

    The last value of a cell wins, by the updates' `seq` if they have one."""
    order = F.col("seq") if "seq" in updates.columns else F.lit(0)
    index = F.aggregate(F.split(F.upper("letter"), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1
    last = updates.groupBy("row_number", index.alias("at")).agg(F.max_by("value", order).alias("value"))
    rows = last.groupBy("row_number").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("new"))
    most = max(x.agg(F.max("row_number")).first()[0] or 0 for x in (sheet, updates))
    numbers = sheet.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("row_number"))
    joined = numbers.join(sheet, "row_number", "left").join(rows, "row_number", "left")
    old = F.coalesce("cells", F.array().cast("array<string>"))
    new = F.coalesce("new", F.create_map().cast("map<int,string>"))
    size = F.greatest(F.size(old), F.coalesce(F.array_max(F.map_keys(new)) + 1, F.lit(0)))
    filled = F.transform(F.filter(F.sequence(F.lit(0), size), lambda i: i < size), lambda i: F.coalesce(F.try_element_at(new, i), F.get(old, i), F.lit("")))
    return joined.select("row_number", filled.alias("cells"))


def upsert_named(rows: DataFrame, updates: DataFrame, key: str = "row_number") -> DataFrame:
    """Records with the updates' columns where they aren't null; other rows as they are. Records grow to the last updated row, new ones being empty."""
    names = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    most = max(x.agg(F.max(key)).first()[0] or 0 for x in (rows, updates))
    every = rows.sparkSession.range(1, most + 1).select(F.col("id").cast(rows.schema[key].dataType).alias(key))
    joined = every.join(rows, key, "left").join(new, key, "left")
    return joined.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns if c != key])


def moved(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue's items with `status`: processed or failed where there is an outcome, else queued."""
    status = outcomes.groupBy("path").agg(F.max("success").alias("ok"))
    joined = queue.join(status, "path", "left")
    return joined.withColumn("status", F.when(F.col("ok").isNull(), "queued").when(F.col("ok"), "processed").otherwise("failed")).drop("ok")


def move_file(source: str, folder: str) -> str:
    """Moves one file of a queue, with a number where the name is taken; gives its new path."""
    import os
    import shutil

    os.makedirs(folder, exist_ok=True)
    stem, ext = os.path.splitext(os.path.basename(source))
    to, n = os.path.join(folder, stem + ext), 1
    while os.path.exists(to):
        to, n = os.path.join(folder, f"{stem}_{n}{ext}"), n + 1
    shutil.move(source, to)
    return to


def html_report(batch: DataFrame, title: str = "Batch report", key: str = "path") -> str:
    """A self-contained page from the report's aggregates; only those reach the driver."""
    t = report.totals(batch, key).first()
    providers = report.by_provider(batch, key).orderBy(F.desc_nulls_last("mean_conf"), "provider").limit(100).collect()
    queue, waiting = report.review_queue(batch, key).collect(), report.review_queue(batch, key, None).count()
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    line = lambda *xs: "<tr>" + "".join(map(cell, xs)) + "</tr>"
    bar = lambda v: f"<td><div style='background:#ddd;width:120px'><div style='background:#467;width:{max(0, min(100, round(100 * (v or 0))))}%'>&nbsp;</div></div></td>"
    by = "".join(line(p.provider, p.pages, "" if p.mean_conf is None else f"{p.mean_conf:.3f}")[:-5] + bar(p.mean_conf) + "</tr>" for p in providers)
    low = "".join(line(r[key], f"{r.min_conf:.3f}", r.low_pages) for r in queue)
    return (
        f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"
        f"<p>{t.docs} documents, {t.pages} pages, {t.chars} characters; {t.textlayer} pages of text, {t.ocr} recognised.</p>"
        f"<h2>Providers</h2><table>{by}</table><h2>To review: {waiting}</h2><table>{low}</table>"
    )


__all__ = ["append_results", "clear", "column_index", "deduplicated", "html_report", "move_file", "moved", "snapshot", "swapped", "upsert_named", "upserted", "write_batch", "write_launched"]
