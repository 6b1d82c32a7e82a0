"""Scans: folders, path lists, JSON lines, sheets, queues, reference images, HTML tables, state."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.text import strip

# Folders that a scan for documents passes over.
PRUNED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "site-packages")
NO_ROWS = "document_id string"


def or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """What read() gives, or no rows of the schema where the path isn't there."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, root: str, glob: str = "*", content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of files below a folder, pruned folders left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    df = df.filter(~F.col("path").rlike("/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"))
    return df if content else df.drop("content")


def pdfs(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, "*.[pP][dD][fF]").orderBy("path")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """path: the stripped lines of a text that aren't blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("path")).filter("path <> ''")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """document_id, each once; none where the list isn't there yet."""
    read = lambda: path_list(spark, path).withColumnRenamed("path", "document_id").distinct()
    return or_empty(read, spark, NO_ROWS)


def batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents of pages from JSON lines; malformed lines are passed over."""
    return spark.read.schema(schemas.BATCH).option("mode", "DROPMALFORMED").json(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results; a bad line stops the query, a missing file gives no rows."""
    return or_empty(lambda: spark.read.schema(schemas.RESULT).option("mode", "FAILFAST").json(path), spark, schemas.RESULT)


def corrections(spark: SparkSession, root: str) -> DataFrame:
    """Corrections from *_metadata.json, one object a file; unreadable files are passed over."""
    read = spark.read.schema(schemas.CORRECTION).option("multiLine", True).option("pathGlobFilter", "*_metadata.json").option("recursiveFileLookup", True).option("mode", "DROPMALFORMED")
    return or_empty(lambda: read.json(root), spark, schemas.CORRECTION)


def reference_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Images under <field>/{correct,error}/, in order of their path."""
    found = files(spark, root, "*.[pPjJ][nNpP][gGeE]*", content)
    return found.filter(F.lower("path").rlike(r"/(correct|error)/[^/]+\.(png|jpg|jpeg)\z")).orderBy("path")


def image_counts(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """field, outcome, n of wanted (field, outcome) pairs; 0 where there is no image."""
    counted = refs.groupBy("field", "outcome").agg(F.count("*").alias("n"))
    return wanted.join(counted, ["field", "outcome"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def decode_arrays(df: DataFrame, content_col: str = "content") -> DataFrame:
    """df with `image` decoded from .npy or PGM bytes; null where that fails. Other formats need an optional library."""
    @F.pandas_udf(schemas.IMAGE)
    def of(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                x = decoded(bytes(data))
                rows.append({"h": x.shape[0], "w": x.shape[1], "data": x.astype("float64").ravel().tolist()})
            except Exception:  # noqa: BLE001  whatever a broken image raises
                rows.append({"h": None, "w": None, "data": None})
        return pd.DataFrame(rows, columns=["h", "w", "data"])

    image = of(content_col)
    return df.withColumn("__i", image).withColumn("image", F.when(F.col("__i.h").isNotNull(), F.col("__i"))).drop("__i")


def decoded(data: bytes):
    """A gray image of .npy, binary PGM (P5) or, where Pillow is there, any of its formats."""
    import io

    import numpy as np

    if data[:6] == b"\x93NUMPY":
        x = np.load(io.BytesIO(data), allow_pickle=False)
        if x.ndim == 3:
            x = x[..., :3] @ np.array([0.299, 0.587, 0.114])
        return x
    if data[:2] == b"P5":
        import re

        m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*\d+\s", data)
        w, h = int(m[1]), int(m[2])
        return np.frombuffer(data[m.end() : m.end() + w * h], np.uint8).reshape(h, w)
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(data)).convert("L"))


def launched(spark: SparkSession, root: str) -> DataFrame:
    """path, seq of a launcher's images: *.png by name, then *.jpg by name, both as they are spelt, of the folder alone."""
    found = [spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select("path", F.lit(n).alias("kind")) for n, glob in enumerate(("*.png", "*.jpg"))]
    return found[0].unionByName(found[1]).withColumn("seq", F.struct("kind", "path")).select("path", "seq")


# --- sheets ---


def column_index(letter: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for c in letter.upper():
        if not "A" <= c <= "Z":
            raise ValueError(f"not a column letter: {letter}")
        n = n * 26 + ord(c) - 64
    if not n:
        raise ValueError("an empty column letter")
    return n - 1


def column_letter(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def csv_sheet(spark: SparkSession, path: str) -> DataFrame:
    """row_number, cells: all strings, ragged rows as they are, no header. One file of a sheet's size."""
    raw = spark.read.text(path, wholetext=True)

    @F.udf("array<array<string>>", useArrow=True)
    def parse(text: str) -> list[list[str]]:
        import csv
        import io

        return list(csv.reader(io.StringIO(text, newline="")))

    return raw.select(F.posexplode(parse("value")).alias("n", "cells")).select((F.col("n") + 1).alias("row_number"), "cells")


def json_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """row_number, cells of a JSON list of records, in the declared order of columns; missing ones are ''."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<map<string,string>>").alias("rows"))
    rows = raw.select(F.posexplode("rows").alias("n", "r"))
    return rows.select((F.col("n") + 1).alias("row_number"), F.array(*[F.coalesce(F.try_element_at("r", F.lit(c)), F.lit("")) for c in columns]).alias("cells"))


def cell(cells: Column, letter: str) -> Column:
    """The cell of a column letter; '' beyond the row's end."""
    return F.coalesce(F.get(cells, F.lit(column_index(letter))), F.lit(""))


def unprocessed(sheet: DataFrame, result_letters: list[str], start_row: int = 2, force: bool = False, from_row: int | None = None) -> DataFrame:
    """Rows from start_row on whose result cells are all blank; force leaves out that test but moves nothing."""
    blank = F.forall(F.array(*[cell(F.col("cells"), x) for x in result_letters]), lambda c: strip(c) == "") if result_letters else F.lit(True)
    rows = sheet.filter(F.col("row_number") >= (from_row or start_row))
    return rows if force else rows.filter(blank)


def failed(sheet: DataFrame, status_letter: str, marker: str = "FAILED") -> DataFrame:
    """Rows after the header whose status cell contains the marker."""
    return sheet.filter((F.col("row_number") >= 2) & F.contains(cell(F.col("cells"), status_letter), F.lit(marker)))


# --- queues, downloads, web pages ---


def queue(spark: SparkSession, root: str) -> DataFrame:
    """Files of a queue folder that aren't hidden, by path."""
    return files(spark, root).filter(~F.col("path").rlike(r"/\.[^/]*\z")).orderBy("path")


def newest_new(now: DataFrame, before: DataFrame) -> DataFrame:
    """path: the file last modified among those that weren't there before; none if there is none."""
    fresh = now.join(before.select("path").distinct(), "path", "left_anti")
    return fresh.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).filter(F.col("path").isNotNull())


# What stands for characters in HTML text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags out, common entities in, stripped."""
    text = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return strip(text)


def table_texts(html: Column, table_id: str | None = None, column: int = 0) -> Column:
    """Array of the texts of one column of a table (by id; None: of all tables), short rows left out."""
    import re

    scope = html if table_id is None else F.regexp_extract(html, rf"""(?is)<table[^>]*\bid\s*=\s*["']?{re.escape(table_id)}["'\s>].*?</table>""", 0)
    rows = F.regexp_extract_all(scope, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.get(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), F.lit(column)))
    return F.transform(F.filter(cells, lambda c: c.isNotNull()), html_text)


def state(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """A snapshot table, or its default where none was written."""
    found = or_empty(lambda: spark.read.schema(schema).parquet(path), spark, schema)
    return default if default is not None and found.isEmpty() else found
