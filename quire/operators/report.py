"""Batch reports over documents of pages: array<struct<n, chars, provider, conf, text>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW_BELOW, REVIEW_SHOWN, TEXT_LAYER = 0.80, 12, "textlayer"


def text_layer_page(text: Column, ocr_text: Column | None = None, ocr_conf: Column | None = None) -> Column:
    """struct(provider, conf, text): the text layer if it isn't blank, else what recognition gave, else nothing."""
    from quire.functions.text import is_blank

    page = lambda p, c, t: F.struct(F.lit(p).alias("provider"), c.cast("double").alias("conf"), t.alias("text"))
    layer, none = page(TEXT_LAYER, F.lit(1.0), text), page("none", F.lit(0.0), F.lit(""))
    if ocr_text is None:
        return F.when(~is_blank(text), layer).otherwise(none)
    return F.when(~is_blank(text), layer).otherwise(page("ocr", F.round(ocr_conf, 3), ocr_text))


def pages(batch: DataFrame, key: str = "path") -> DataFrame:
    return batch.select(key, F.explode("pages").alias("page")).select(key, "page.*")


def needs_review(provider: Column, conf: Column) -> Column:
    return provider.isNotNull() & (provider != TEXT_LAYER) & (F.coalesce(conf, F.lit(0.0)) < REVIEW_BELOW)


def totals(batch: DataFrame, key: str = "path") -> DataFrame:
    """docs, pages, chars, textlayer, ocr: one row; every page without a text layer counts as ocr."""
    own = F.col("page.provider")
    rows = batch.select(F.explode_outer("pages").alias("page"), F.lit(1).alias("one"))
    sums = rows.agg(
        F.count("page").alias("pages"), F.coalesce(F.sum("page.chars"), F.lit(0)).cast("long").alias("chars"),
        F.count_if(own == TEXT_LAYER).alias("textlayer"), F.count_if(F.col("page").isNotNull() & ~F.coalesce(own == TEXT_LAYER, F.lit(False))).alias("ocr"),
    )
    return batch.agg(F.count("*").alias("docs")).join(F.broadcast(sums))  # one row each


def by_provider(batch: DataFrame, key: str = "path") -> DataFrame:
    """provider (`?` where none is named), pages, and mean confidence with its n of recognised pages."""
    told = F.col("provider").isNotNull() & (F.col("provider") != TEXT_LAYER)
    rows = pages(batch, key).groupBy(F.coalesce("provider", F.lit("?")).alias("name"))
    conf = F.when(told, F.coalesce("conf", F.lit(0.0)))
    return rows.agg(F.count("*").alias("pages"), F.avg(conf).alias("mean_conf"), F.count(conf).alias("n_conf")).withColumnRenamed("name", "provider")


def review_queue(batch: DataFrame, key: str = "path", shown: int | None = REVIEW_SHOWN) -> DataFrame:
    """Documents with pages to review, least confident first: key, min_conf, low_pages."""
    low = pages(batch, key).filter(needs_review(F.col("provider"), F.col("conf")))
    queue = low.groupBy(key).agg(F.min(F.coalesce("conf", F.lit(0.0))).alias("min_conf"), F.count("*").alias("low_pages"))
    return queue if shown is None else queue.orderBy("min_conf", key).limit(shown)


def provider_benchmark(runs: DataFrame) -> DataFrame:
    """docs, seconds and chars by provider of runs (provider, seconds, text)."""
    return runs.groupBy("provider").agg(F.count("*").alias("docs"), F.sum("seconds").alias("seconds"), F.sum(F.length("text")).alias("chars"))


def scanned(pages: DataFrame, recognise=None, max_pages: int | None = None, key: str = "path") -> DataFrame:
    """key, n, chars, provider, conf, text of pages (key, n, layer): the text layer, else what `recognise` reads, else nothing.

    recognise: a provider, run on pages without a text layer alone; None: text layers only. Confidences have three places."""
    from quire.functions.text import is_blank

    if max_pages is not None:
        pages = pages.filter(F.col("n") <= max_pages)
    blank = is_blank(F.col("layer"))
    read = pages.filter(~blank).select(key, "n", F.lit(TEXT_LAYER).alias("provider"), F.lit(1.0).alias("conf"), F.col("layer").alias("text"))
    rest = pages.filter(blank)
    if recognise is None:
        rest = rest.select(key, "n", F.lit("none").alias("provider"), F.lit(0.0).alias("conf"), F.lit("").alias("text"))
    else:
        r = F.col("reading")
        rest = recognise(rest).select(key, "n", F.coalesce(r["provider"], F.lit("none")).alias("provider"), F.round(F.coalesce(r["confidence"], F.lit(0.0)), 3).alias("conf"), F.coalesce(r["text"], F.lit("")).alias("text"))
    return read.unionByName(rest).select(key, "n", F.length("text").alias("chars"), "provider", "conf", "text")
