"""Table sources.

``read_table`` scans parquet with the columns a job needs (pruned at the scan).
The heavy stages here are row-local (chunking, extraction), so their parallelism
is that of the scan; ``spark.sql.files.maxPartitionBytes`` sizes its splits, and
a caller with one large row group may ``repartition`` what it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df
