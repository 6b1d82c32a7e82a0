"""What the operators of this subpackage share: table access, checkpoints and Arrow iteration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that are handled at a time: texts of a few kB make a MB or so.
BATCH_ROWS = 256
#: Bytes after which Spark closes an Arrow batch, and the setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are closed after BATCH_BYTES unless the session has a bound of its own.

    It's the one setting that the operators make: Spark knows none for a single frame, and frames run after the operator has returned.
    Results never depend on it."""
    spark = df.sparkSession
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, cut to so many each, since texts may be long."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; one of our own only where the session names none and runs on this machine alone, as in tests."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder: only the columns that are asked for are read again."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_rows(df: DataFrame, group: str, mark: Column, then: list[str], most: int) -> DataFrame:
    """Of each group the rows of the least hash, `most` at most; groups are few.

    Rows of a group are counted first, and those of a hash that can't be among the least stay where they are:
    a handful of times `most` rows of a group meet in one task, however many partitions there are."""
    span = 1 << 30
    marked = df.withColumn(own := spare(df, "mark"), F.pmod(mark, F.lit(span)))
    size = {r[0]: r[1] for r in marked.groupBy(group).count().collect()}
    if not size:
        return df.limit(0)
    low = F.coalesce(*[F.when(F.col(group) == g, F.lit(span if n <= 4 * most else span * 4 * most // n)) for g, n in size.items() if g is not None], F.lit(span))
    place = spare(marked, "place")
    ranked = marked.filter(F.col(own) < low).withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(own, *then)))
    return ranked.filter(F.col(place) <= most).drop(own, place)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text, null texts as empty ones: extra columns never clash."""
    return bounded(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, of_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Maps pieces of Arrow batches; no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if (out := of_batch(batch)) is not None:
                yield out

    return bounded(df).mapInArrow(run, schema)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def literal(values: list, kind: str) -> Column:
    """A constant array of numbers, folded by the optimizer: one literal, however many values."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
