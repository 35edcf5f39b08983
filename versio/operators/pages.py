"""Page handling (C1-C6): split an extracted text into pages, page counts,
documents without pages, and the full-text (unsplit) mode - narrow
projections / generators, no exchange - plus ``pages_from_rows`` for documents
stored as page rows, which numbers a document's pages block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versio.functions.text import PAGE_MARKER, is_blank, split_on_marker, strip


def split_pages(docs: DataFrame, *, text_col: str = "text", key: str = "doc_id",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(key, text) -> pages(key, page_idx INT, page STRING).

    Pages are stripped and blank pages dropped *before* ``posexplode``, so
    ``page_idx`` is dense from 0 over the kept pages.
    """
    kept = F.filter(F.transform(split_on_marker(text_col), strip), lambda p: p != F.lit(""))
    return (
        docs.select(F.col(key), *carry, F.posexplode(kept).alias("page_idx", "page"))
        .withColumn("page_idx", F.col("page_idx").cast("int"))
    )


def page_counts(docs: DataFrame, *, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Number of non-blank pages per document (0 included), without exploding."""
    text = F.coalesce(F.col(text_col), F.lit(""))  # a NULL text has no page
    kept = F.filter(F.transform(split_on_marker(text), strip), lambda p: p != F.lit(""))
    return docs.select(F.col(key), F.size(kept).cast("bigint").alias("n_pages"))


def no_page_documents(docs: DataFrame, *, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents with no non-blank page (the reference raises; we report).

    Computed from the array size on the document row itself, so there is no
    anti join and no shuffle.
    """
    return (
        page_counts(docs, text_col=text_col, key=key)
        .where(F.col("n_pages") == 0)
        .select(key, F.lit("no_pages").alias("status"))
    )


def full_text_units(docs: DataFrame, *, text_col: str = "text", key: str = "doc_id",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """One translation unit per document, markers included, no split. A document without a
    non-blank page (NULL, blank, markers only) is no unit; ``no_page_documents`` reports it."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(PAGE_MARKER), F.lit(""))
    return docs.where(~is_blank(text)).select(
        F.col(key), *carry,
        F.lit(0).alias("page_idx"), F.lit(0).alias("chunk_idx"),
        F.col(text_col).alias("chunk"),
    )


#: Order values that make one block of a key.
ORDER_BLOCK = 1024


def dense_positions(df: DataFrame, key: str, order: str, out: str = "idx", block: int = ORDER_BLOCK) -> DataFrame:
    """0-based position of every row within its ``key`` in the numeric ``order`` (a dense row_number).

    A key is cut into blocks of ``block`` order values. Rows are numbered within their block, so one
    key's rows are dealt over many tasks, and the rows of earlier blocks are added from the blocks'
    counts (one narrow row per block). Rows that share key and order are ranked by a hash of their
    columns. NULL keys form one key, NULL orders come first."""
    cols, at = df.columns, F.floor(F.col(order) / F.lit(block))
    counts = df.groupBy(F.col(key).alias("__k"), at.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__k", "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    within = Window.partitionBy(key, "__at").orderBy(order, F.xxhash64(*cols))
    numbered = df.withColumn("__at", at).withColumn("__pos", F.row_number().over(within) - 1)
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__at").eqNullSafe(F.col("__b"))
    return numbered.join(offsets, same).select(*cols, (F.col("__pos") + F.col("__off")).alias(out))


def pages_from_rows(rows: DataFrame, *, key: str = "doc_id", order: str = "page_no", text: str = "text") -> DataFrame:
    """B5 + C1 for documents stored as page rows: (key, order, text) ->
    pages(doc_id, page_idx INT, page) with pages stripped, blank pages dropped
    and a dense index in page order - the pages ``split_pages(mark_pages(rows))``
    gives when no page text contains the marker, but without building one
    string per document, so no document is ever gathered in one task."""
    kept = rows.select(F.col(key).alias("doc_id"), F.col(order).alias("__order"),
                       strip(text).alias("page")).where(F.col("page") != "")
    ranked = dense_positions(kept, "doc_id", "__order", "page_idx")
    return ranked.select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), "page")
