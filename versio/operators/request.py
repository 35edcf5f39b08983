"""Request building and model resolution.

All projections and broadcast equi-joins against fixed-size dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.functions.text import col_of
from versio.sources import dimensions as dims


def user_message(text, lang) -> Column:
    """The user turn sent with every chunk."""
    return F.concat(F.lit("Translate to "), col_of(lang), F.lit(":\n"), col_of(text))


def _body(style: str, model: Column, system: Column, user: Column, temperature: Column,
          max_tokens: Column) -> Column:
    if style == "chat":
        return F.to_json(F.struct(
            model.alias("model"),
            F.array(
                F.struct(F.lit("system").alias("role"), system.alias("content")),
                F.struct(F.lit("user").alias("role"), user.alias("content")),
            ).alias("messages"),
            temperature.alias("temperature"),
            max_tokens.alias("max_tokens"),
        ))
    if style == "system_field":
        return F.to_json(F.struct(
            model.alias("model"),
            max_tokens.alias("max_tokens"),
            temperature.alias("temperature"),
            system.alias("system"),
            F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
        ))
    if style == "config":
        return F.to_json(F.struct(
            model.alias("model"),
            user.alias("contents"),
            F.struct(
                temperature.alias("temperature"),
                max_tokens.alias("max_output_tokens"),
                system.alias("system_instruction"),
            ).alias("config"),
        ))
    raise ValueError(f"unknown request style {style!r}")


def build_requests(chunks: DataFrame, *, provider_col: str = "provider", model_col: str = "model",
                   lang_col: str = "target_lang", text_col: str = "chunk",
                   system_prompt: str = dims.SYSTEM_PROMPT, temperature: float = dims.TEMPERATURE,
                   max_tokens: int = dims.MAX_OUTPUT_TOKENS) -> DataFrame:
    """Adds system, user, temperature, max_tokens, request_style and the JSON
    ``body`` in the provider's request shape (one branch per style). Provider names match
    whatever their case; an unknown provider (E5) or a missing target language gives a NULL
    body, which ``send_requests`` reports and does not post."""
    spark = chunks.sparkSession
    styled = chunks.join(
        dims.providers(spark).select(F.col("provider").alias("__p"), "request_style"),
        F.lower(F.col(provider_col)) == F.col("__p"), "left",
    ).drop("__p")
    system = F.lit(system_prompt)
    user = user_message(text_col, lang_col)
    temp = F.lit(float(temperature))
    cap = F.lit(int(max_tokens))
    model = F.col(model_col)
    body = F.when(F.col("request_style") == "chat", _body("chat", model, system, user, temp, cap))
    for style in ("system_field", "config"):
        body = body.when(F.col("request_style") == style, _body(style, model, system, user, temp, cap))
    return styled.select(
        *chunks.columns,
        system.alias("system"),
        user.alias("user"),
        temp.alias("temperature"),
        cap.alias("max_tokens"),
        "request_style",
        body.alias("body"),
    )


def resolve_models(specs: DataFrame, spark: SparkSession | None = None, *,
                   provider_col: str = "provider", model_col: str = "model",
                   aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """Lower-case the provider once (X5), apply explicit aliases (off by
    default, X4), fill the default model when none is given, flag models the
    provider does not list, and mark unknown providers.

    -> specs + provider_resolved, model_resolved, model_known, status.
    """
    spark = spark or specs.sparkSession
    p = F.lower(F.col(provider_col))
    df = specs.withColumn("__p", p)
    if aliases:
        al = dims.aliases(spark, aliases).select(F.col("alias").alias("__a"), F.col("provider").alias("__ap"))
        df = (df.join(al, F.col("__p") == F.col("__a"), "left")
              .withColumn("__p", F.coalesce(F.col("__ap"), F.col("__p")))
              .drop("__a", "__ap"))
    dm = dims.default_models(spark).withColumnRenamed("provider", "__dp")
    km = dims.known_models(spark).select(F.col("provider").alias("__kp"), F.col("model").alias("__km"),
                                         F.lit(True).alias("__listed"))
    pv = dims.providers(spark).select(F.col("provider").alias("__pp"), F.lit(True).alias("__known_provider"))
    model = F.coalesce(F.nullif(F.col(model_col), F.lit("")), F.col("default_model"))
    out = (
        df.join(dm, F.col("__p") == F.col("__dp"), "left")
        .join(pv, F.col("__p") == F.col("__pp"), "left")
        .withColumn("model_resolved", model)
        .join(km, (F.col("__p") == F.col("__kp")) & (F.col("model_resolved") == F.col("__km")), "left")
    )
    has_list = F.col("__p") == F.lit("openrouter")
    return out.select(
        *specs.columns,
        F.col("__p").alias("provider_resolved"),
        "model_resolved",
        F.when(has_list, F.coalesce(F.col("__listed"), F.lit(False))).otherwise(F.lit(True)).alias("model_known"),
        F.when(F.col("__known_provider").isNull(), F.lit("unknown_provider"))
        .when(F.col("model_resolved").isNull(), F.lit("no_model"))
        .otherwise(F.lit("ok")).alias("status"),
    )
