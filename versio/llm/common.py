"""Small helpers shared by the operators: fresh column names, tables written to
the cluster's shared folder, and a join with a per-key table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.session import ensure_checkpoint_dir

#: A per-key table of at most this many rows may be broadcast (its rows hold a key and a few numbers).
BROADCAST_ROWS = 50_000
#: Parts into which the rows of every key are dealt when such a table is too long to broadcast.
SALTS = 32


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores appended until no column is called that (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends there, and a
    lost executor costs only the tasks that were running."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unsent(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table`` as one side of a sort-merge join whatever the session's broadcast threshold is, if ``rows``, a bound
    of its rows, is over ``BROADCAST_ROWS`` or not known. Spark estimates a table from the size of its files, without
    the rows that ``explode`` adds and what compression takes off, and would send one of many times that threshold
    through the driver."""
    return table if rows is not None and rows <= BROADCAST_ROWS else table.hint("merge")


def join_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt_by: Column, how: str = "left") -> DataFrame:
    """Join ``rows`` with a table of one row per key. The table is counted first: up to
    ``BROADCAST_ROWS`` rows it is broadcast; beyond that the rows of each key are dealt over
    ``SALTS`` parts and the table is repeated for each part, so that a hot key never meets one
    task. Both ways give the same rows. Keys match null to null."""
    small = written(table, "keys")
    names = list(rows.columns)
    right = {k: fresh([*names, *table.columns], f"_{k}_right") for k in keys}
    small = small.withColumnsRenamed(right)
    on = [F.col(k).eqNullSafe(F.col(r)) for k, r in right.items()]
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how).drop(*right.values())
    left_salt, right_salt = fresh(names, "_salt"), fresh(names, "_salt_right")
    salted = rows.withColumn(left_salt, F.pmod(salt_by, F.lit(SALTS)))
    small = small.withColumn(right_salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(unsent(small), [*on, F.col(left_salt) == F.col(right_salt)], how).drop(left_salt, right_salt, *right.values())
