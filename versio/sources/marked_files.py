"""Pages of marker-separated text files of any size (A1 + C1).

Spark's text source cuts the files at the page marker instead of the line feed:
a record is a page, found by the task that holds its block, so a file is read
by as many tasks as it has blocks and is never one row. The dense page number
of the reference (blank pages do not count) is the number of a page within its
block, counted as the block is read, plus the pages of the blocks before it.
Only the block counts are added up; the text is not shuffled.

The record reader can overlook a marker at the edge of its buffer when a part of
the marker stands right before it, so each record is split again. Blocks must be
longer than the marker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versio.functions.text import PAGE_MARKER, strip
from versio.session import written

#: A table of block offsets of at most this many rows is broadcast (a path and two numbers a row); a longer one
#: is joined by file and block, of which each is one block of text.
BROADCAST_BLOCKS = 50_000


def _within_blocks(records: DataFrame) -> DataFrame:
    """(doc_id, block, page) in the order of the scan -> with ``nth``, the number of the page in its block. A task
    reads the records of a block one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if not keys:
                continue
            nth = np.empty(len(keys), np.int64)
            for k, key in enumerate(keys):
                if key != last:
                    last, count = key, 0
                nth[k], count = count, count + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], [*batch.schema.names, "nth"])

    return records.mapInArrow(run, "doc_id string, block bigint, page string, nth bigint")


def marked_file_pages(spark: SparkSession, path: str, *, marker: str = PAGE_MARKER, glob: str | None = None) -> DataFrame:
    """pages(doc_id, page_idx BIGINT, page) of every text file below ``path``; ``doc_id`` is the file's path.

    Pages are stripped and blank ones dropped before they are numbered, as ``split_pages`` does. A file without a
    page has no row. A page must fit in a row, a file need not."""
    reader = spark.read.option("lineSep", marker).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.text(path).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.explode(F.split("value", marker, -1)).alias("piece"))
    records = found.select("doc_id", "block", strip("piece").alias("page")).where("page <> ''")
    counts = records.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("pages"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("doc_id").alias("__file"), F.col("block").alias("__block"), F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("__before"))
    offsets = written(offsets, "block-offsets")  # so that it can be counted before it is joined
    if offsets.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    numbered = _within_blocks(records)
    joined = numbered.join(offsets, (F.col("doc_id") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.select("doc_id", (F.col("__before") + F.col("nth")).alias("page_idx"), "page")

