"""Incremental translation of documents that keep arriving.

Page split and chunking are stateless row-local projections, so they run
unchanged on a ``readStream`` source. Each micro-batch goes through
``answer_units`` into a folder of its own below the sink: answers are committed
in small units, and a batch that is replayed after a failure reads that folder
alone and sends what is not answered yet. No state store is needed; the sink is
the record of what was done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from versio.functions.text import DEFAULT_CHUNK_TOKENS
from versio.operators.dispatch import answer_units, read_answers
from versio.plans.translate_job import plan_chunks

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING"


def document_stream(spark: SparkSession, source_dir: str, schema: str = DOCUMENT_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_dir)


def read_stream(spark: SparkSession, sink_path: str) -> DataFrame | None:
    """The answers of all batches, one row per chunk and language (None before the first)."""
    return read_answers(spark, sink_path)


def translate_stream(docs: DataFrame, service, *, sink_path: str, checkpoint_location: str,
                     target_langs: Sequence[str] = ("en",), limit: int = DEFAULT_CHUNK_TOKENS,
                     concurrency: int = 4, unit_rows: int = 100_000, available_now: bool = True, trigger_interval: str = "30 seconds",
                     **dispatch_opts) -> StreamingQuery:
    """Start the streaming job; chunks flow into ``sink_path`` (parquet, a
    folder per batch, run and unit of about ``unit_rows`` requests) as ``translations`` rows.
    ``available_now`` processes what is there and stops; otherwise a
    micro-batch runs every ``trigger_interval``."""
    chunks = plan_chunks(docs.select("doc_id", "text"), limit=limit)
    langs = list(target_langs)

    def run_batch(batch: DataFrame, epoch: int) -> None:
        answer_units(batch, service, f"{sink_path}/batch_id={epoch}", langs=langs, unit_rows=unit_rows,
                     concurrency=concurrency, **dispatch_opts)

    writer = (chunks.writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger_interval)
    return writer.start()
