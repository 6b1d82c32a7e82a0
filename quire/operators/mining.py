"""Error patterns mined from pairs of expected and detected numbers, and the adjustments they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.monitor import percent

# How many patterns are kept, and by how much a region grows below which success rate.
TOP_CONFUSIONS, TOP_AFFIXES, TOP_RULES = 10, 3, 5
LOW_RATE, MEDIUM_RATE, LARGE_STEP, SMALL_STEP = 40.0, 60.0, 0.10, 0.05
DARK, BLURRED = 0.8, 0.7


def references(files: DataFrame, path_col: str = "path") -> DataFrame:
    """field, outcome, filename, expected, detected of image files under <field>/{correct,error}/."""
    parts = F.split(path_col, "/")
    rows = files.select(F.element_at(parts, -3).alias("field"), F.element_at(parts, -2).alias("outcome"), F.element_at(parts, -1).alias("filename"))
    rows = rows.filter(F.col("outcome").isin("correct", "error") & F.lower("filename").rlike(r"\.(png|jpg|jpeg)\z"))
    return rows.withColumn("__p", T.parse_reference_name(F.col("filename"))).select("field", "outcome", "filename", "__p.expected", "__p.detected")


def success_rates(refs: DataFrame) -> DataFrame:
    """field, correct, error, rate of references with an outcome."""
    found = refs.groupBy("field").agg(F.count_if(F.col("outcome") == "correct").alias("correct"), F.count_if(F.col("outcome") == "error").alias("error"))
    return found.withColumn("rate", percent(F.col("correct"), F.col("correct") + F.col("error")))


def global_rate(rates: DataFrame) -> DataFrame:
    """correct, error, rate over all fields: one row."""
    return rates.agg(F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.coalesce(F.sum("error"), F.lit(0)).alias("error")).withColumn("rate", percent(F.col("correct"), F.col("correct") + F.col("error")))


def patterns(pairs: DataFrame, order: str = "seq") -> DataFrame:
    """field, kind, position, expected, detected, count, first_seen of error pairs (field, expected, detected, order).

    Kinds: prefix, suffix (in `detected`), missing (`start` or `end` in `detected`), confusion."""
    e, d = F.col("expected"), F.col("detected")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    row = lambda kind, at, x, y: F.struct(F.lit(kind).alias("kind"), at.alias("position"), x.alias("expected"), y.alias("detected"))
    single = F.array(row("prefix", number, none, T.added_prefix(e, d)), row("suffix", number, none, T.added_suffix(e, d)), row("missing", number, none, T.missing_end(e, d)))
    single = F.filter(single, lambda x: x["detected"].isNotNull())
    swaps = F.transform(T.confusions(e, d), lambda x: row("confusion", x["position"], x["expected"], x["detected"]))
    rows = pairs.filter(e.isNotNull() & d.isNotNull()).select("field", F.col(order).alias("__order"), F.explode(F.concat(single, swaps)).alias("x")).select("field", "__order", "x.*")
    return rows.groupBy("field", "kind", "position", "expected", "detected").agg(F.count("*").alias("count"), F.min("__order").alias("first_seen"))


def top(found: DataFrame, kind: str, k: int) -> DataFrame:
    """The k most frequent patterns of a kind in each field, those seen first among equals."""
    w = Window.partitionBy("field").orderBy(F.desc("count"), "first_seen", "position")
    return found.filter(F.col("kind") == kind).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def grouped_confusions(swaps: DataFrame, order: str = "seq") -> DataFrame:
    """expected, detected, frequency by first appearance."""
    return swaps.groupBy("expected", "detected").agg(F.count("*").alias("frequency"), F.min(order).alias("first_seen"))


def region_step(rate: Column) -> Column:
    return F.when(rate < LOW_RATE, LARGE_STEP).when(rate < MEDIUM_RATE, SMALL_STEP).otherwise(0.0)


def expanded(roi: Column, step: Column) -> Column:
    """struct(top, bottom, left, right) grown on all sides within the image."""
    less, more = lambda c: F.greatest(F.lit(0.0), c - step), lambda c: F.least(F.lit(1.0), c + step)
    return F.struct(less(roi["top"]).alias("top"), more(roi["bottom"]).alias("bottom"), less(roi["left"]).alias("left"), more(roi["right"]).alias("right"))


def rules(found: DataFrame) -> DataFrame:
    """field, rules: array<struct<type, pattern>> from the top affixes, prefixes first."""
    parts = [top(found, kind, TOP_AFFIXES).select("field", F.struct(F.lit(n).alias("n"), "rank", F.lit(f"strip_{kind}").alias("type"), F.col("detected").alias("pattern")).alias("x")) for n, kind in enumerate(("prefix", "suffix"))]
    ordered = parts[0].unionByName(parts[1]).groupBy("field").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ordered.select("field", F.transform("x", lambda r: F.struct(r["type"].alias("type"), r["pattern"].alias("pattern"))).alias("rules"))


def adjusted(config: DataFrame, rates: DataFrame, found: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The configuration (field, roi, preprocessing, min_confidence, correction_rules) after one analysis, with n_changes.

    Only fields with correct and with error references change. Rules that are there already aren't added again.
    features: field, outcome, brightness, sharpness."""
    both = rates.filter("correct > 0 AND error > 0")
    df = config.join(both.select("field", "rate"), "field", "left").join(rules(found), "field", "left")
    step = F.when(F.col("rate").isNull(), 0.0).otherwise(region_step(F.col("rate")))
    fresh = F.when(F.col("rate").isNotNull(), F.array_except(F.coalesce("rules", F.array().cast("array<struct<type:string,pattern:string>>")), "correction_rules")).otherwise(F.array().cast("array<struct<type:string,pattern:string>>"))
    pre, changes = F.col("preprocessing"), (step > 0).cast("int") + F.size(fresh)
    if features is not None:
        of = lambda c, o: F.max(F.when(F.col("outcome") == o, F.col(c)))
        ratios = features.groupBy("field").agg((of("brightness", "error") < DARK * of("brightness", "correct")).alias("dark"), (of("sharpness", "error") < BLURRED * of("sharpness", "correct")).alias("blurred"))
        df = df.join(ratios, "field", "left")
        dark = F.coalesce("dark", F.lit(False)) & F.col("rate").isNotNull() & (pre["threshold"] != "clahe")
        blurred = F.coalesce("blurred", F.lit(False)) & F.col("rate").isNotNull() & (pre["blur_kernel"] != 1)
        changes = changes + dark.cast("int") + blurred.cast("int")
        pre = F.struct(F.when(dark, "clahe").otherwise(pre["threshold"]).alias("threshold"), F.when(blurred, 1).otherwise(pre["blur_kernel"]).alias("blur_kernel"), pre["clahe"].alias("clahe"))
    return df.select("field", expanded(F.col("roi"), step).alias("roi"), pre.alias("preprocessing"), "min_confidence", F.concat("correction_rules", fresh).alias("correction_rules"), changes.alias("n_changes"))


def learning_summary(config: DataFrame, found: DataFrame, rates: DataFrame) -> DataFrame:
    """field, correction_rules, patterns (confusions kept), and the field's success rate to one place, of the configuration's fields."""
    kept = top(found, "confusion", TOP_CONFUSIONS).groupBy("field").agg(F.count("*").alias("patterns"))
    df = config.select("field", F.size("correction_rules").cast("long").alias("correction_rules")).join(kept, "field", "left").join(rates.select("field", "rate"), "field", "left")
    return df.select("field", "correction_rules", F.coalesce("patterns", F.lit(0).cast("long")).alias("patterns"), F.round(F.coalesce("rate", F.lit(0.0)), 1).alias("success_rate"))


def kept_rates(now: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """initial_success_rate, current_success_rate of global_rate's row: the initial one stays that of the first analysis that wasn't 0."""
    current = now.select(F.col("rate").alias("current_success_rate"))
    before = first.select("initial_success_rate") if first is not None else now.select(F.lit(0.0).alias("initial_success_rate"))
    both = current.join(F.broadcast(before))  # one row each
    return both.select(F.when(F.col("initial_success_rate") > 0, F.col("initial_success_rate")).otherwise(F.col("current_success_rate")).alias("initial_success_rate"), "current_success_rate")
