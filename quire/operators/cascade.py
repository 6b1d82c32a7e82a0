"""The cascade: the best reading of a document under a confidence policy.

The dear provider runs on what the cheap one leaves over: rows are split by a filter before it, for
a UDF under `when` would be called for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.functions.text import is_blank, strip

THRESHOLD = 0.90
#: Modes that are tried in this order, and the least length of a text.
MODES, LEAST_CHARS = (6, 4, 3, 11), 4
READING = "struct<text:string,confidence:double,provider:string>"
Provider = Callable[[DataFrame], DataFrame]


def reading(text: Column, confidence: Column, provider: Column) -> Column:
    return F.struct(text.alias("text"), confidence.cast("double").alias("confidence"), provider.cast("string").alias("provider"))


def accepted(fast: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the fast reading suffices; the threshold is included."""
    return fast.isNotNull() & ~is_blank(fast["text"]) & F.coalesce(fast["confidence"] >= threshold, F.lit(False))


def corrected(accurate: Column, corrector: Callable[[Column], Column] | None) -> Column:
    """A reading after the corrector; a blank answer changes nothing."""
    if corrector is None:
        return accurate
    answer = corrector(accurate["text"])
    new = reading(answer, accurate["confidence"], F.concat(accurate["provider"], F.lit("+llm")))
    return F.when(is_blank(answer) | is_blank(accurate["text"]), accurate).otherwise(new)


def choose(fast: Column, accurate: Column, threshold: float = THRESHOLD, corrector: Callable[[Column], Column] | None = None) -> Column:
    """The reading that wins; a null struct is a provider that failed.

    An accurate reading that isn't empty wins over a fast one that wasn't accepted, whatever its confidence."""
    nothing = reading(F.lit(""), F.lit(0.0), F.lit("cascade"))
    better = F.when(fast["confidence"] >= accurate["confidence"], fast).otherwise(accurate)
    return (
        F.when(accepted(fast, threshold), fast)
        .when(accurate.isNotNull() & ~is_blank(accurate["text"]), corrected(accurate, corrector))
        .when(fast.isNull() & accurate.isNull(), nothing)
        .when(accurate.isNull(), fast).when(fast.isNull(), accurate).otherwise(better)
    )


def cascade(docs: DataFrame, fast: Provider, accurate: Provider | None, threshold: float = THRESHOLD, corrector: Callable[[Column], Column] | None = None, validator: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with `reading` and `provider_chain`.

    A provider adds a column `reading` to the rows that it is given. validator: a column of the text, kept as `checked`."""
    first = fast(docs).withColumnRenamed("reading", "__fast")
    done = first.filter(accepted(F.col("__fast"), threshold)).withColumn("reading", F.col("__fast")).withColumn("provider_chain", F.array(F.col("__fast.provider")))
    rest = first.filter(~accepted(F.col("__fast"), threshold))
    rest = accurate(rest).withColumnRenamed("reading", "__accurate") if accurate else rest.withColumn("__accurate", F.lit(None).cast(READING))
    rest = rest.withColumn("reading", choose(F.col("__fast"), F.col("__accurate"), threshold, corrector))
    rest = rest.withColumn("provider_chain", F.array_compact(F.array(F.col("__fast.provider"), F.col("__accurate.provider")))).drop("__accurate")
    out = done.unionByName(rest).drop("__fast")
    return out.withColumn("checked", validator(F.col("reading.text"))) if validator else out


def best_mode(candidates: DataFrame, key: str = "doc_id", mode: str = "mode", modes: tuple = MODES) -> DataFrame:
    """Of candidates (key, mode, text, confidence) each key's most confident, the earlier mode of equals.

    Texts of fewer than LEAST_CHARS characters never win, nor does a confidence of 0."""
    place = F.array_position(F.array(*map(F.lit, modes)), F.col(mode))
    ok = candidates.filter((F.length(strip(F.col("text"))) >= LEAST_CHARS) & (F.col("confidence") > 0) & (place > 0))
    ranked = ok.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), place)))
    return ranked.filter("__n = 1").drop("__n")


def mean_confidence(values: Column) -> Column:
    """Mean of an array of confidences, 0 if there are none."""
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0))
