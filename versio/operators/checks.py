"""Status tables and the optional preservation check.

The reference stops the run at the first problem; a table of documents
reports each problem per row instead, and ``strict`` turns a non-empty
problem set into an error with ``raise_error`` inside the job (no collect).
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.functions.text import is_blank, split_on_marker, strip


def document_status(extracted: DataFrame, *, text_col: str = "text") -> DataFrame:
    """extracted(doc_id, text) -> (doc_id, n_pages, status) where status is
    ``empty_extraction`` (B7: blank or NULL text), ``no_pages`` (C2: only markers and
    blanks, X10) or ``ok``. Row-local: no exchange."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.filter(F.transform(split_on_marker(text), strip), lambda p: p != F.lit(""))
    n = F.size(kept).cast("bigint")
    status = (F.when(is_blank(text), F.lit("empty_extraction"))
              .when(n == 0, F.lit("no_pages"))
              .otherwise(F.lit("ok")))
    return extracted.select("doc_id", n.alias("n_pages"), status.alias("status"))


def strict(df: DataFrame, bad, message: str) -> DataFrame:
    """Fail the job when any row satisfies ``bad`` (the reference's exception),
    checked inside the job with ``raise_error``."""
    return df.where(F.when(bad, F.raise_error(F.lit(message))).isNull())


# --- V1: things the prompt asks the service to leave untouched ----------------

# fixed patterns (valid in both Java regex and RE2): URLs, DOIs, display math,
# inline math. A display block also holds one inline match; both counts are
# reported as they are.
PRESERVE_PATTERNS = {
    "url": r"https?://[^ \t\n\r<>\"]+",
    "doi": r"10\.[0-9]{4,9}/[^ \t\n\r<>\"]+",
    "display_math": r"\$\$[^$]+\$\$",
    "inline_math": r"\$[^$]+\$",
}


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _lost(*pairs: pd.Series) -> pd.Series:
    """For each pair of item arrays (source, answer), how many items of the source have no counterpart in the
    answer, repeats counted: the difference of two multisets, linear in the items."""
    kinds = list(zip(pairs[::2], pairs[1::2], strict=True))
    columns = [[(Counter(a) - Counter(() if b is None else b)).total() if a is not None and len(a) else 0 for a, b in zip(x, y, strict=True)] for x, y in kinds]
    return pd.Series(list(zip(*columns, strict=True)))


def preservation_check(translations: DataFrame, chunks: DataFrame | None = None,
                       keys=("doc_id", "page_idx", "chunk_idx")) -> DataFrame:
    """Per document and target language: how many protected items of each kind
    the source chunks hold, and how many of them are missing from the answer (an item
    that the source repeats has to be repeated as often).

    Best fed with translations that carry their source ``chunk`` (dispatch
    with ``keep_text=True``): then it is a projection plus a sum aggregation
    (partial aggregation before the exchange). Otherwise the chunks are joined
    back on the full chunk key."""
    j = translations
    if "chunk" not in translations.columns:
        j = translations.join(chunks.select(*keys, "chunk"), list(keys), "inner")
    found = {}
    for name, pat in PRESERVE_PATTERNS.items():
        found[f"{name}_src"] = F.regexp_extract_all("chunk", F.lit(pat), F.lit(0))
        found[f"{name}_dst"] = F.regexp_extract_all("translated", F.lit(pat), F.lit(0))
    items = j.select("doc_id", "target_lang", *(c.alias(n) for n, c in found.items()))
    counted = items.withColumn("__lost", _lost(*found))
    cols = []
    for k, name in enumerate(PRESERVE_PATTERNS):
        cols += [F.size(f"{name}_src").alias(f"{name}_n"), F.col("__lost")[k].alias(f"{name}_lost")]
    per_chunk = counted.select("doc_id", "target_lang", *cols)
    sums = [F.sum(c).cast("bigint").alias(c) for c in per_chunk.columns[2:]]
    return per_chunk.groupBy("doc_id", "target_lang").agg(*sums)
