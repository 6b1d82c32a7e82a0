"""Human corrections: error flags, statistics, substitution rules and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Length of a pattern's sides, patterns kept a field, and what a rule needs.
CUT, TOP, LEAST_FREQUENCY, TRUSTED, OFTEN, SYSTEMIC = 10, 5, 2, 0.7, 0.5, 0.3
NOTHING_READ = "N/A"


def flagged(corrections: DataFrame, flag_mode: str = "corrected") -> DataFrame:
    """corrections (maps expected, detected, corrected) with `errors`: <field>_was_wrong for each expected field, and both_wrong.

    A field was wrong if corrected (flag_mode `detected`: detected) isn't expected. Nothing detected is written as N/A."""
    against = F.col(flag_mode)
    keys = F.map_keys("expected")
    wrong = lambda k: ~F.element_at("expected", k).eqNullSafe(F.try_element_at(against, k))
    entries = F.transform(keys, lambda k: F.struct(F.concat(k, F.lit("_was_wrong")).alias("key"), wrong(k).alias("value")))
    both = F.array(F.struct(F.lit("both_wrong").alias("key"), F.forall(keys, wrong).alias("value")))
    detected = F.transform_values("detected", lambda _, v: F.when(F.coalesce(v, F.lit("")) == "", NOTHING_READ).otherwise(v))
    return corrections.withColumn("errors", F.map_from_entries(F.concat(entries, both))).withColumn("detected", detected)


def wrong_fields(corrections: DataFrame, order: str = "seq") -> DataFrame:
    """field, detected, corrected, seq of flagged fields where both are there."""
    rows = corrections.select(order, "detected", "corrected", "errors", F.explode(F.map_keys("expected")).alias("field"))
    rows = rows.filter(F.coalesce(F.try_element_at("errors", F.concat("field", F.lit("_was_wrong"))), F.lit(False)))
    rows = rows.select("field", F.try_element_at("detected", F.col("field")).alias("detected"), F.try_element_at("corrected", F.col("field")).alias("corrected"), F.col(order).alias("seq"))
    return rows.filter((F.coalesce("detected", F.lit("")) != "") & (F.coalesce("corrected", F.lit("")) != ""))


def substitutions(corrections: DataFrame, order: str = "seq") -> DataFrame:
    """field, detected, correction, frequency, rank: each field's most frequent substitutions of the first characters."""
    head = lambda c: F.substr(F.col(c), F.lit(1), F.lit(CUT))
    rows = wrong_fields(corrections, order).select("field", head("detected").alias("detected"), head("corrected").alias("correction"), "seq")
    counted = rows.groupBy("field", "detected", "correction").agg(F.count("*").alias("frequency"), F.min("seq").alias("first_seen"))
    w = Window.partitionBy("field").orderBy(F.desc("frequency"), "first_seen")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP).drop("first_seen")


def promoted(corrections: DataFrame, order: str = "seq") -> DataFrame:
    """Rules: substitutions seen twice or more, with expected_precision = frequency / all corrections."""
    total = corrections.agg(F.count("*").alias("__all"))  # one row
    found = substitutions(corrections, order).filter(F.col("frequency") >= LEAST_FREQUENCY).join(F.broadcast(total))
    return found.withColumn("expected_precision", F.col("frequency") / F.col("__all")).drop("__all")


def current_precision(corrections: DataFrame, order: str = "seq") -> DataFrame:
    """field, errors, precision = 1 - errors / all corrections."""
    total = corrections.agg(F.count("*").alias("__all"))  # one row
    errors = wrong_fields(corrections, order).groupBy("field").agg(F.count("*").alias("errors"))
    return errors.join(F.broadcast(total)).select("field", "errors", (1 - F.col("errors") / F.col("__all")).alias("precision"))


def apply_learning(values: DataFrame, rules: DataFrame, field_col: str = "field", value_col: str = "detected", expected_col: str = "expected") -> DataFrame:
    """values with `improved`: trusted rules of the field, by rank, replace all they find; rows without value or expectation stay.

    There are TOP rules a field at most, so that a join on the field carries a short array."""
    trusted = rules.filter(F.col("expected_precision") > TRUSTED)
    ordered = trusted.groupBy(F.col("field").alias("__field")).agg(F.array_sort(F.collect_list(F.struct("rank", "detected", "correction"))).alias("__rules"))
    joined = values.join(ordered, F.col(field_col) == F.col("__field"), "left")
    usable = (F.coalesce(F.col(value_col), F.lit("")) != "") & (F.coalesce(F.col(expected_col), F.lit("")) != "") & F.col("__rules").isNotNull()
    return joined.withColumn("improved", F.when(usable, T.substitute(F.col(value_col), F.col("__rules"))).otherwise(F.col(value_col))).drop("__field", "__rules")


def statistics(corrections: DataFrame) -> DataFrame:
    """field, wrong, total, both_wrong, suggested: a field is suggested if it is wrong in over half of all corrections."""
    rows = corrections.select(F.explode("errors").alias("key", "wrong"))
    counted = rows.filter("key <> 'both_wrong' AND wrong").groupBy(F.regexp_replace("key", "_was_wrong", "").alias("field")).agg(F.count("*").alias("wrong"))
    total = corrections.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.try_element_at("errors", F.lit("both_wrong")), F.lit(False))).alias("both_wrong"))  # one row
    joined = counted.join(F.broadcast(total))
    return joined.withColumn("suggested", F.col("wrong") > F.col("total") * OFTEN).withColumn("systemic", F.col("both_wrong") > F.col("total") * SYSTEMIC)


def running(corrections: DataFrame) -> DataFrame:
    """total_corrections, fully_corrected: one row."""
    both = F.coalesce(F.try_element_at("errors", F.lit("both_wrong")), F.lit(False))
    return corrections.agg(F.count("*").alias("total_corrections"), F.count_if(~both).alias("fully_corrected"))


def matches_expected(expected: Column, name: Column) -> Column:
    """Whether a reference file is of the expected number; names without a number are let through."""
    number = T.leading_number(name)
    return number.isNull() | (number == expected)


def model_status(rules: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_rules of all declared fields."""
    known = rules.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    counted = rules.groupBy("field").agg(F.count("*").alias("n_rules"))
    return known.join(counted, "field", "left").select("field", F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"))
