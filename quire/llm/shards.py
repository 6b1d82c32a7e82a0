"""Contiguous shards of near equal bytes from global prefix sums.

Rows are put in order of doc_id by a range exchange that carries three numbers a row, never
the text. Each partition gives its total; the totals of all partitions (as many rows as
partitions) are summed on the driver into the offset at which each starts, so that a running
sum inside a partition is a global one. The line of all bytes is cut at equal targets: a row
belongs to the shard in which its middle byte lies, so that a shard's size is off by at most
one row.

Cases: a null text has size 1 (the terminator) and CRC 0; null ids come first; rows that are
equal in all that is read are dealt in any order among themselves, which gives the same
result; an empty table gives no rows; columns other than id and text are not read. A single
id that has a large part of the rows is split over partitions by its CRC and row position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

SHARDS = 16


def by_bytes(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slots count from 0 in each shard, in order of doc_id."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    text = F.col(text_col).cast("string")
    sized = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    dealt = sized.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))  # both passes must see the same partitions
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    first, bytes_before, rows_before = {}, 0, 0
    for r in sorted(totals, key=lambda r: r.part):
        first[r.part] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + r.bytes, rows_before + r.rows
    total = max(1, bytes_before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            size = b["size"].to_numpy(zero_copy_only=False)
            at_byte, at_row = first[b["part"][0].as_py()] if at is None else at
            ends = at_byte + np.cumsum(size)
            shard = np.minimum(shards - 1, (2 * ends - size) * shards // (2 * total))
            at = int(ends[-1]), at_row + len(size)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["size"], b["text_crc32"], pa.array(shard.astype(np.int32)), pa.array(np.arange(at_row, at[1], dtype=np.int64))], ["doc_id", "size", "text_crc32", "shard", "row"])

    placed = dealt.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, row long")
    starts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("shard_row")).alias("slot"))
