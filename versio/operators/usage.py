"""Usage totals, counts, prices and the cost report.

Sums are declared with ``groupBy().agg`` so Spark runs partial aggregation
before the exchange (map-side combine); a hot document only costs one
partial row per task. Prices are a fixed 4-row dimension, broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.functions.text import col_of
from versio.sources import dimensions as dims


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _totals() -> list[Column]:
    p = F.coalesce(F.col("prompt_tokens"), _zero())
    c = F.coalesce(F.col("completion_tokens"), _zero())
    return [
        F.sum(p).cast("bigint").alias("prompt_tokens_total"),
        F.sum(c).cast("bigint").alias("completion_tokens_total"),
        F.sum(p + c).cast("bigint").alias("total_tokens_total"),
    ]


def usage_by_document(translations: DataFrame, keys=("doc_id", "target_lang")) -> DataFrame:
    """G2 per (doc_id, target_lang): prompt, completion and total tokens,
    chunk count (G3) and failed chunks (G5)."""
    return translations.groupBy(*keys).agg(
        *_totals(),
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def usage_total(translations: DataFrame) -> DataFrame:
    """G2 over everything (no group)."""
    return translations.agg(
        *_totals(),
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def chunks_per_page(chunks: DataFrame) -> DataFrame:
    """Chunk count per page."""
    return chunks.groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n_chunks"))


def cost_expr(prompt, completion, input_per_m, output_per_m) -> Column:
    """prompt/1e6 * input price + completion/1e6 * output price (DOUBLE)."""
    return (col_of(prompt) / F.lit(1_000_000)) * col_of(input_per_m) + \
           (col_of(completion) / F.lit(1_000_000)) * col_of(output_per_m)


def estimate_cost(usage: DataFrame, *, model_col: str = "model", cache_col: str = "cache") -> DataFrame:
    """F1 + H10: price lookup by (model, cache) against the broadcast price table.

    An unknown model or a cache value other than hit/miss gets
    ``status='no_price'`` and a NULL cost instead of failing the job (X21).
    """
    prices = dims.pricing(usage.sparkSession).select(
        F.col("model").alias("__m"), F.col("cache").alias("__c"), "input_per_m", "output_per_m"
    )
    joined = usage.join(
        prices, (F.col(model_col) == F.col("__m")) & (F.col(cache_col) == F.col("__c")), "left"
    )
    found = F.col("__m").isNotNull()
    return joined.select(
        *usage.columns,
        F.when(found, cost_expr("prompt_tokens_total", "completion_tokens_total",
                                "input_per_m", "output_per_m")).alias("cost_usd"),
        F.when(found, F.lit("ok")).otherwise(F.lit("no_price")).alias("cost_status"),
    )


def reply_tokens(parsed: DataFrame) -> DataFrame:
    """Adds ``hit_tokens`` and ``miss_tokens``, the input tokens that the provider read from its cache and the
    others, from the raw ``usage`` of ``parse_responses(raw_usage=True)``. Providers name them differently: hits and
    misses apart, hits as a detail of the prompt's tokens, or beside input tokens that do not hold them. A reply
    that tells nothing of its cache has misses alone."""
    def tokens(path: str) -> Column:
        return F.try_variant_get("usage", path, "bigint")

    beside = tokens("$.cache_read_input_tokens")
    hit = F.coalesce(tokens("$.prompt_cache_hit_tokens"), tokens("$.prompt_tokens_details.cached_tokens"), beside, _zero())
    total = F.col("prompt_tokens")
    miss = (F.when(tokens("$.prompt_cache_miss_tokens").isNotNull(), tokens("$.prompt_cache_miss_tokens"))
            .when(beside.isNotNull(), total + F.coalesce(tokens("$.cache_creation_input_tokens"), _zero()))
            .otherwise(F.greatest(total - hit, _zero())))
    counted = F.col("usage_reported")
    return parsed.withColumns({"hit_tokens": F.when(counted, hit).otherwise(_zero()), "miss_tokens": F.when(counted, miss).otherwise(_zero())})


def reply_cost(replies: DataFrame, *, model_col: str = "model") -> DataFrame:
    """F1 by what the replies themselves say: cached input tokens at the price of a hit, the others at that of a
    miss. A model without prices gets ``no_price`` and a NULL cost."""
    prices = dims.cache_prices(replies.sparkSession).withColumnRenamed("model", "__m")
    joined = replies.join(prices, F.col(model_col) == F.col("__m"), "left")
    cost = (F.col("hit_tokens") / F.lit(1_000_000) * F.col("hit_per_m") + F.col("miss_tokens") / F.lit(1_000_000) * F.col("miss_per_m")
            + F.col("completion_tokens") / F.lit(1_000_000) * F.col("output_per_m"))
    return joined.select(*replies.columns, cost.alias("cost_usd"), F.when(F.col("__m").isNull(), "no_price").otherwise("ok").alias("cost_status"))


@F.pandas_udf(T.StringType())
def _money(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"${v:.4f}")


def with_money(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out`` = ``$%.4f`` of ``value``, formatted by Python itself: it rounds the exact binary value
    half-to-even, where Spark's ``format_string`` rounds the shortest decimal form half-up (0.03125). One row
    per document and language, so the hop to Python is over a table of sums."""
    return df.withColumn(out, _money(F.col(value)))


def usage_report(priced: DataFrame) -> DataFrame:
    """The printed summary as a table (one row per input row)."""
    report = with_money(priced, "cost_usd", "__money")
    return report.select(
        *[c for c in priced.columns if c != "cost_usd"],
        F.round("cost_usd", 8).alias("cost_usd"),
        F.when(F.col("cost_status") == "ok", F.col("__money")).alias("cost_text"),
    )
