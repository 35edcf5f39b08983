"""Usage totals kept up to date on a stream of answers.

The state of a page (of a document in a language) is the set of what its chunks were answered: whether it was an
answer and with how many tokens. A chunk counts once however often its answer comes, in a replayed batch or from a
second run, and an answer replaces an earlier failure; of several answers with different tokens the one with the
fewest counts. The state is a set, so the order of arrival does not matter. It is a streaming aggregation, kept and
merged by Spark without a call to Python for each page. A page's totals are written with the batch that changed
them; the current totals of a document are the sum over the newest row of each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAGE = ["doc_id", "target_lang", "page_idx"]
TOTALS = ["prompt_tokens_total", "completion_tokens_total", "n_chunks", "n_failed"]


def answer_stream(spark: SparkSession, sink: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """The answers that ``answer_units`` commits to ``sink``, as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(f"{sink.rstrip('/')}/run=*/unit=*")


def _chunk_totals(answers: Column) -> Column:
    """Totals of an array of (chunk_idx, failed, prompt_tokens, completion_tokens): the first of every chunk counts,
    in the order of the fields."""
    zero = F.lit(0).cast("bigint")

    def step(now: Column, x: Column) -> Column:
        new = ~now["chunk"].eqNullSafe(F.struct(x["chunk_idx"].alias("idx")))
        add = (x["prompt_tokens"], x["completion_tokens"], F.lit(1), x["failed"].cast("int"))
        totals = [(now[t] + F.when(new, v).otherwise(0)).cast("bigint").alias(t) for t, v in zip(TOTALS, add, strict=True)]
        return F.struct(F.struct(x["chunk_idx"].alias("idx")).alias("chunk"), *totals)

    none = F.lit(None).cast("struct<idx:int>").alias("chunk")
    return F.aggregate(F.array_sort(answers), F.struct(none, *[zero.alias(t) for t in TOTALS]), step)


def page_totals(answers: DataFrame) -> DataFrame:
    """The totals of every page that a batch of the stream ``answers`` changes."""
    answer = F.struct(F.col("chunk_idx").cast("int").alias("chunk_idx"), (~F.col("status").eqNullSafe("ok")).alias("failed"),
                      *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("prompt_tokens", "completion_tokens")])
    pages = answers.groupBy(*PAGE).agg(F.collect_set(answer).alias("answers"))
    return pages.select(*PAGE, _chunk_totals(F.col("answers")).alias("now")).select(*PAGE, *[F.col(f"now.{t}").alias(t) for t in TOTALS])


def usage_stream(answers: DataFrame, path: str, checkpoint_location: str, *, available_now: bool = True, trigger_interval: str = "30 seconds") -> StreamingQuery:
    """Start keeping page totals in the table ``path``, a folder per batch; a batch that is run again replaces its own."""
    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={epoch}")

    writer = page_totals(answers).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger_interval)).start()


def current_usage(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, target_lang, totals, n_chunks, n_failed) as of the last batch: the columns of ``usage_by_document``."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy(*PAGE).agg(F.max_by(F.struct(*TOTALS), "batch_id").alias("now"))
    p, c = F.sum("now.prompt_tokens_total"), F.sum("now.completion_tokens_total")
    return newest.groupBy("doc_id", "target_lang").agg(
        p.alias("prompt_tokens_total"), c.alias("completion_tokens_total"), (p + c).alias("total_tokens_total"),
        F.sum("now.n_chunks").alias("n_chunks"), F.sum("now.n_failed").alias("n_failed"))
