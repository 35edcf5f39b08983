"""SQL surface (U3, U4): the public helpers as functions callable from SQL.

``approx_tokens`` and ``estimate_cost`` are SQL functions (``CREATE TEMPORARY
FUNCTION ... RETURN``), so they inline into the plan like any built-in
expression; ``chunk_text`` is the Arrow-batched chunker UDF. ``chunks`` is a table function that gives the
chunks of a text as rows, for ``FROM docs, LATERAL chunks(docs.text, 200)``: rows stream out of the worker and no
array of them is built. A NULL text has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from versio.functions.text import PAGE_MARKER, py_approx_tokens
from versio.operators.chunk import _chunk_udf, chunk_text_py
from versio.sources.dimensions import PRICES


def _cost_case() -> str:
    arms = " ".join(
        f"WHEN model = '{m}' AND cache = '{c}' THEN "
        f"prompt_tokens / 1000000 * CAST({i!r} AS DOUBLE) + completion_tokens / 1000000 * CAST({o!r} AS DOUBLE)"
        for m, c, i, o in PRICES
    )
    return f"CASE {arms} END"


class Chunks:
    """Table function: the chunks of a text's pages (C1 + D1-D5)."""

    def eval(self, text: str, limit: int) -> Iterator[tuple]:
        pages = (p for p in map(str.strip, (text or "").split(PAGE_MARKER)) if p)
        for page_idx, page in enumerate(pages):
            for chunk_idx, chunk in enumerate(chunk_text_py(page, limit)):
                yield page_idx, chunk_idx, chunk, py_approx_tokens(chunk)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunks", udtf(Chunks, returnType="page_idx int, chunk_idx int, chunk string, chunk_tokens bigint", useArrow=True))
    spark.udf.register("chunk_text", _chunk_udf)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION approx_tokens(s STRING) RETURNS BIGINT "
        "RETURN CAST(ceil(length(s) / 4) AS BIGINT)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION estimate_cost(model STRING, prompt_tokens BIGINT, "
        f"completion_tokens BIGINT, cache STRING) RETURNS DOUBLE RETURN {_cost_case()}"
    )
