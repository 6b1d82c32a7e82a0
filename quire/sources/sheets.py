"""Sheet backends: a reader and a writer of the same sheet."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import readers, sinks


class Sheet:
    """rows(): row_number, cells. update(): cells by row_number, letter, value."""

    def rows(self) -> DataFrame:
        raise NotImplementedError

    def update(self, updates: DataFrame) -> None:
        raise NotImplementedError


def csv_line(cells):
    """Cells as a line of CSV, quoted where they have to be; an empty row is an empty line."""
    one = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, one), ",")


@dataclass
class CsvSheet(Sheet):
    """A folder of one CSV file; no rows where there is none yet."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return readers.or_empty(lambda: readers.csv_sheet(self.spark, self.path), self.spark, "row_number int, cells array<string>")

    def update(self, updates: DataFrame) -> None:
        new = sinks.upserted(self.rows(), updates).orderBy("row_number").select(csv_line(F.col("cells")).alias("value"))
        sinks.swapped(self.spark, self.path, lambda path: new.coalesce(1).write.mode("overwrite").text(path))


@dataclass
class JsonSheet(Sheet):
    """A folder of one JSON list of records with declared columns; letters stand for them in order."""

    spark: SparkSession
    path: str
    columns: list[str]

    def rows(self) -> DataFrame:
        return readers.or_empty(lambda: readers.json_sheet(self.spark, self.path, self.columns), self.spark, "row_number int, cells array<string>")

    def update(self, updates: DataFrame) -> None:
        new = sinks.upserted(self.rows(), updates)
        record = F.struct(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(self.columns)])
        whole = new.groupBy().agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row_number", record.alias("r")))), lambda x: x["r"])).alias("value"))  # a sheet is one file
        sinks.swapped(self.spark, self.path, lambda path: whole.coalesce(1).write.mode("overwrite").text(path))


@dataclass
class CloudSheet(Sheet):
    """A live sheet; client() opens it, with get_all_values() and update_acell(cell, value). Credentials come from the argument or the environment."""

    spark: SparkSession
    client: Callable[[str], object]
    credentials: str | None = None
    variable: str = "GOOGLE_APPLICATION_CREDENTIALS"

    def available(self) -> bool:
        return bool(self.credentials or os.environ.get(self.variable))

    def _open(self):
        if not self.available():
            raise FileNotFoundError(f"no credentials: set {self.variable} or pass them")
        if not hasattr(self, "_opened"):
            self._opened = self.client(self.credentials or os.environ[self.variable])
        return self._opened

    def rows(self) -> DataFrame:
        found = [(i, list(map(str, r))) for i, r in enumerate(self._open().get_all_values(), 1)]
        return self.spark.createDataFrame(found, "row_number int, cells array<string>")

    def update(self, updates: DataFrame) -> None:
        """Cell by cell, as the service takes them; empty values are left out."""
        sheet = self._open()
        for r in updates.filter(F.coalesce("value", F.lit("")) != "").toLocalIterator():
            sheet.update_acell(f"{r.letter}{r.row_number}", r.value)
