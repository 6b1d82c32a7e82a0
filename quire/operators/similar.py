"""Similar references: a join on edit distance, and what near numbers teach about a target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

MAX_DISTANCE, MAX_SIMILAR, SURE = 2, 5, 3.0
#: Variants that meet in a task; each is a row of some 50 bytes.
KEYS_A_TASK = 250_000


def variants(text: Column, distance: int) -> Column:
    """All different strings that are left when up to `distance` characters are taken away."""
    out = F.array(text)
    for _ in range(distance):
        shorter = lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: i > 0), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def _tasks(distance: int, *columns: tuple[DataFrame, str]) -> int:
    """So many tasks that each gets KEYS_A_TASK variants of the columns at most, on average."""
    keys = 0
    for df, name in columns:
        size = F.length(F.col(name).cast("string"))
        count = term = F.lit(1.0)
        for d in range(distance):
            term = term * (size - d) / (d + 1)
            count = count + term
        keys += df.agg(F.sum(count)).first()[0] or 0
    least = int(columns[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(keys / KEYS_A_TASK))


def pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, distance: int = MAX_DISTANCE, carried: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """left_key, right_key, distance of all pairs of different values within the distance.

    Strings within it have a variant in common, so an equi-join finds all of them; no pair of values is tried blindly.
    Pairs are measured as they meet, and only those within the distance are kept and made unique. The number of tasks follows
    the number of variants, so that a task's memory doesn't grow with the tables. carried: columns of right that its key decides."""
    n = tasks or _tasks(distance, (left, left_key), (right, right_key))

    def side(df: DataFrame, key: str, name: str, more: tuple[str, ...] = ()) -> DataFrame:
        values = df.select(F.col(key).cast("string").alias(name), *more).filter(F.col(name).isNotNull()).repartition(n, name).distinct()
        return values.withColumn("__v", F.explode(variants(F.col(name), distance))).repartition(n, "__v")

    a, b = side(left, left_key, "__a"), side(right, right_key, "__b", carried)
    found = a.join(b.hint("merge"), "__v").withColumn("distance", F.levenshtein("__a", "__b", distance))
    taken = F.greatest(F.length("__a"), F.length("__b")) - F.length("__v")  # a pair also meets with no more taken away than its distance
    found = found.filter(F.col("distance").between(0, distance) & (taken <= F.col("distance"))).drop("__v").repartition(n, "__a").distinct()
    return found.select(F.col("__a").alias(left_key), F.col("__b").alias(right_key), "distance", *carried)


def preferred_path(paths: Column) -> Column:
    """The first path of a manual reference, else the first."""
    return F.coalesce(F.try_element_at(F.filter(paths, lambda p: F.lower(p).contains("manual")), F.lit(1)), F.try_element_at(paths, F.lit(1)))


def similar_references(targets: DataFrame, index: DataFrame, k: int = MAX_SIMILAR, distance: int = MAX_DISTANCE, similarity: Column | None = None) -> DataFrame:
    """target, number, distance, similarity, path, priority, rank: the k most similar of the index (number, paths, seq).

    Most similar first, manual references before others, then as in the index. similarity: of target, number and distance; default: the
    matching-blocks ratio. Each target's k numbers are chosen by their first references, which travel with them; only then are others met."""
    index = index.withColumn("path", preferred_path(F.col("paths")))
    index = index.withColumn("priority", F.when(F.lower("path").contains("manual"), "manual").otherwise("automatic"))
    index = index.withColumn("__late", (F.col("priority") != "manual").cast("int")).select("number", "path", "priority", "__late", "seq")
    order, n = ("__late", "seq"), _tasks(distance, (targets, "target"), (index, "number"))
    ranked = index.repartition(n, "number").withColumn("__n", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("__n") <= k)
    found = pairs(targets, ranked.filter("__n = 1"), "target", "number", distance, order, n)
    found = found.withColumn("similarity", T.similarity_ratio(F.col("target"), F.col("number")) if similarity is None else similarity)
    w = Window.partitionBy("target").orderBy(F.desc("similarity"), *order)
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank", *order).join(ranked, "number")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("target", "number", "distance", "similarity", "path", "priority", "rank")


def strategies(similar: DataFrame) -> DataFrame:
    """target, prefixes, suffixes (sorted, each once), confusions (position, expected, detected) and confidence."""
    t, n = F.col("target"), F.col("number")
    rows = similar.select("target", "rank", T.added_prefix(t, n).alias("p"), T.added_suffix(t, n).alias("s"), T.confusions(t, n).alias("c"))
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "c")))
    return rows.groupBy("target").agg(
        F.array_sort(F.collect_set("p")).alias("prefixes"), F.array_sort(F.collect_set("s")).alias("suffixes"),
        F.flatten(F.transform(by_rank, lambda x: x["c"])).alias("confusions"), F.least(F.lit(1.0), F.count("*") / SURE).alias("confidence"),
    )
