"""Parsing raw provider replies.

One wide JSON schema reads every reply shape; absent fields come back NULL,
so a single ``from_json`` serves all providers (each body is parsed once) and the choice of field is a
``CASE`` on the reply style. Runs in the JVM, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY_SCHEMA = (
    "choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>, "
    "content ARRAY<STRUCT<type: STRING, text: STRING>>, "
    "text STRING, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT, "
    "input_tokens: BIGINT, output_tokens: BIGINT>"
)


def parse_responses(raw: DataFrame, *, body_col: str = "body", style_col: str = "reply_style", raw_usage: bool = False) -> DataFrame:
    """raw(..., reply_style, body) -> raw + translated, status, prompt_tokens,
    completion_tokens, usage_reported, and with ``raw_usage`` the reply's whole usage (E12) as ``usage``, a VARIANT:
    every key the provider sent, whatever its shape (``usage.reply_tokens`` reads the cached tokens from it).

    Styles: ``choices`` (first choice's message; usage dict or nothing),
    ``choices_or_empty`` (same, NULL content read as ""), ``content_blocks``
    (first block's text; input/output usage keys), ``text_only`` (``text``;
    the service reports no usage). A reply without text is ``failed``.
    """
    # the generator keeps the parsed struct: without it every field read below would parse the body again
    parsed = raw.select("*", F.explode_outer(F.array(F.from_json(F.col(body_col), REPLY_SCHEMA))).alias("__reply"))
    j = F.col("__reply")
    style = F.col(style_col)
    first_choice = F.try_element_at(j["choices"], F.lit(1))["message"]["content"]
    text = (
        F.when(style == "choices", first_choice)
        .when(style == "choices_or_empty",
              F.when(j["choices"].isNotNull() & (F.size(j["choices"]) > 0), F.coalesce(first_choice, F.lit(""))))
        .when(style == "content_blocks", F.try_element_at(j["content"], F.lit(1))["text"])
        .when(style == "text_only", j["text"])
    )
    u = j["usage"]
    zero = F.lit(0).cast("bigint")
    counted = style != F.lit("text_only")
    prompt = F.when(counted, F.coalesce(u["prompt_tokens"], u["input_tokens"], zero)).otherwise(zero)
    completion = F.when(counted, F.coalesce(u["completion_tokens"], u["output_tokens"], zero)).otherwise(zero)
    reported = (u["prompt_tokens"].isNotNull() | u["completion_tokens"].isNotNull()
                | u["input_tokens"].isNotNull() | u["output_tokens"].isNotNull())
    ok = text.isNotNull()
    return parsed.select(
        *raw.columns,
        text.alias("translated"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, prompt).otherwise(zero).alias("prompt_tokens"),
        F.when(ok, completion).otherwise(zero).alias("completion_tokens"),
        (ok & counted & F.coalesce(reported, F.lit(False))).alias("usage_reported"),
        *([F.try_variant_get(F.try_parse_json(F.col(body_col)), "$.usage", "variant").alias("usage")] if raw_usage else []),
    )
