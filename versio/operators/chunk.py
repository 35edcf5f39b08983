"""Token-limited chunking of pages.

A page is cut into *runs*: a run is either a maximal stretch of short lines
(estimate < limit) or one long line (estimate >= limit). Runs never share a
chunk. Inside a run the atoms (lines, or the words of the long line) are packed
greedily: a new bin opens when adding the next atom would pass the limit.
Costs: a line costs ceil(len/4) (newlines are free), a word ceil((len+1)/4).
A word run whose first word alone passes the limit therefore opens with an
empty bin, which yields the empty chunk "" (D4). A long line with no words
yields nothing (X13). Line bins are joined with "\\n", word bins with " ".

Two interchangeable implementations, same output:

* ``chunk_array`` - Arrow-batched pandas UDF; the fold runs in a Python worker,
  one page per row, linear in the page length. Primary, fastest.
* ``chunk_array_native`` - JVM only, built from ``aggregate``/``transform``
  over arrays; no Python worker. Quadratic only in bins within one long line
  and in line chunks within one page.

Both are row-local (no shuffle): scaling is by pages, and a page is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.functions.batches import pieces
from versio.functions.text import (
    DEFAULT_CHUNK_TOKENS,
    PAGE_MARKER,
    approx_tokens,
    col_of,
    split_lines,
    words,
)


# --- Python helper (runs inside an Arrow batch) ------------------------------

def _bin_starts(costs: list[int], limit: int) -> list[int]:
    """Offsets where greedy bins start; always begins with 0."""
    starts = [0]
    append = starts.append
    used = 0
    for pos, cost in enumerate(costs):
        used += cost
        if used > limit:
            append(pos)
            used = cost
    return starts


def _emit_bins(atoms: list[str], costs: list[int], limit: int, sep: str, out: list[str]) -> None:
    starts = _bin_starts(costs, limit)
    if len(starts) == 1:
        out.append(sep.join(atoms))
        return
    ends = starts[1:]
    ends.append(len(atoms))
    out.extend([sep.join(atoms[a:b]) for a, b in zip(starts, ends)])


def chunk_text_py(page: str, limit: int = DEFAULT_CHUNK_TOKENS) -> list[str]:
    """Chunks of one page, in order (plain Python; used by the Arrow UDF).

    Costs use integer shifts: ceil(n/4) = (n+3)>>2 for a line and
    ceil((n+1)/4) = (n+4)>>2 for a word."""
    out: list[str] = []
    run_lines: list[str] = []
    run_costs: list[int] = []
    for line in page.split("\n"):
        cost = (len(line) + 3) >> 2
        if cost < limit:
            run_lines.append(line)
            run_costs.append(cost)
            continue
        if run_lines:
            _emit_bins(run_lines, run_costs, limit, "\n", out)
            run_lines, run_costs = [], []
        ws = line.split()
        if ws:
            _emit_bins(ws, [(len(w) + 4) >> 2 for w in ws], limit, " ", out)
    if run_lines:
        _emit_bins(run_lines, run_costs, limit, "\n", out)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunk_udf(pages: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series(
        [None if p is None else chunk_text_py(p, int(n)) for p, n in zip(pages, limits)]
    )


def chunk_array(page, limit: int = DEFAULT_CHUNK_TOKENS) -> Column:
    """ARRAY<STRING> of the page's chunks (Arrow UDF)."""
    return _chunk_udf(col_of(page), F.lit(int(limit)))


# --- JVM twin ----------------------------------------------------------------

def _word_cost(w: Column) -> Column:
    return F.ceil((F.length(w) + F.lit(1)) / F.lit(4)).cast("bigint")


def _bins_of(costs: Column, limit: Column, make) -> Column:
    """Greedy bins over ``costs``; ``make(start, end)`` builds one element per bin.

    The starts array is a lambda variable of the finish function, so it is
    computed once per call even though every bin reads its successor.
    """
    init = F.struct(
        F.array(F.lit(0)).alias("starts"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("k")
    )

    def step(s, c):
        opens = s["used"] + c > limit
        return F.struct(
            F.when(opens, F.concat(s["starts"], F.array(s["k"]))).otherwise(s["starts"]).alias("starts"),
            F.when(opens, c).otherwise(s["used"] + c).alias("used"),
            (s["k"] + 1).alias("k"),
        )

    def finish(s):
        st = s["starts"]
        return F.transform(st, lambda a, j: make(a, F.coalesce(F.try_element_at(st, j + 2), s["k"])))

    return F.aggregate(costs, init, step, finish)


# A chunk descriptor; its natural struct order is the chunk order. Line chunks:
# (start line, start line, end line, false); word bins of line i: (i, first
# word, end word, true). A line chunk never starts on a long line, and the
# empty bin of D4 is (i, 0, 0), before (i, 0, b).
_DESC = "struct<pos:int,sa:int,sb:int,w:boolean>"


def _desc(pos: Column, a: Column, b: Column, w: bool) -> Column:
    return F.struct(pos.cast("int").alias("pos"), a.cast("int").alias("sa"), b.cast("int").alias("sb"),
                    F.lit(w).alias("w"))


def chunk_array_native(df: DataFrame, page: str, limit: int, out: str = "chunks") -> DataFrame:
    """Adds column ``out`` = ARRAY<STRING> of chunks, using JVM array functions only.

    Per line: its estimate and, for a long line, its words. Word bins depend
    only on their own line, so they come from an independent ``transform``;
    only the short-line chunks need a fold across lines. The two descriptor
    lists are merged by one ``array_sort`` and the text is joined at the end.
    Cost: linear in lines, plus the square of bins within one long line and of
    line chunks within one page (arrays are immutable, so a fold that appends
    copies); the Arrow helper is linear throughout.
    """
    lim = F.lit(int(limit)).cast("bigint")
    tmp = df.withColumn("__lines", split_lines(page))
    tmp = tmp.withColumn("__t", F.transform("__lines", lambda l: approx_tokens(l)))
    tmp = tmp.withColumn(
        "__ln",
        F.transform(
            "__lines",
            lambda l, i: F.struct(
                i.alias("i"),
                F.element_at(F.col("__t"), i + 1).alias("t"),
                F.when(F.element_at(F.col("__t"), i + 1) >= lim, words(l))
                .otherwise(F.array().cast("array<string>")).alias("ws"),
            ),
        ),
    )

    empty = F.array().cast(f"array<{_DESC}>")

    def word_bins(x):
        costs = F.transform(x["ws"], _word_cost)
        bins = _bins_of(costs, lim, lambda a, b: _desc(x["i"], a, b, True))
        return F.when(F.size(x["ws"]) == 0, empty).otherwise(bins)

    def step(s, x):
        is_long = x["t"] >= lim
        flush = F.when(s["open"] >= 0, F.array(_desc(s["open"], s["open"], x["i"], False))).otherwise(empty)
        on_long = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).alias("open"),
                           F.concat(s["out"], flush).alias("out"))
        on_full = F.struct(x["t"].alias("used"), x["i"].alias("open"), F.concat(s["out"], flush).alias("out"))
        on_add = F.struct(
            (s["used"] + x["t"]).alias("used"),
            F.when(s["open"] < 0, x["i"]).otherwise(s["open"]).alias("open"),
            s["out"].alias("out"),
        )
        return F.when(is_long, on_long).when(s["used"] + x["t"] > lim, on_full).otherwise(on_add)

    init = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).alias("open"), empty.alias("out"))

    def finish(s):
        tail = F.when(s["open"] >= 0,
                      F.array(_desc(s["open"], s["open"], F.size("__lines"), False))).otherwise(empty)
        return F.concat(s["out"], tail)

    tmp = tmp.withColumn("__wb", F.flatten(F.transform("__ln", word_bins)))
    tmp = tmp.withColumn("__lc", F.aggregate("__ln", init, step, finish))
    tmp = tmp.withColumn("__desc", F.array_sort(F.concat("__lc", "__wb")))

    def text_of(d):
        word_slice = F.slice(F.element_at(F.col("__ln"), d["pos"] + 1)["ws"], d["sa"] + 1, d["sb"] - d["sa"])
        line_slice = F.slice(F.col("__lines"), d["sa"] + 1, d["sb"] - d["sa"])
        return F.when(d["w"], F.array_join(word_slice, " ")).otherwise(F.array_join(line_slice, "\n"))

    return tmp.withColumn(out, F.transform("__desc", text_of)).drop("__lines", "__t", "__ln", "__wb", "__lc",
                                                                     "__desc")


# --- operators -----------------------------------------------------------------

#: Documents whose chunks are returned in one Arrow batch.
_BATCH_ROWS = 500


def _chunk_batches(batches: Iterator[pa.RecordBatch], n: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The first ``n`` columns of each document and its chunks; column ``n`` is the text. Bounded in rows and bytes."""
    for whole in batches:
        for batch in pieces(whole, rows=_BATCH_ROWS):
            row, page_no, chunk_no, out = [], [], [], []
            for k, text in enumerate(batch.column(n).to_pylist()):
                pages = (p for p in map(str.strip, (text or "").split(PAGE_MARKER)) if p)
                for p, page in enumerate(pages):
                    found = chunk_text_py(page, limit)
                    row += [k] * len(found)
                    page_no += [p] * len(found)
                    chunk_no += range(len(found))
                    out += found
            which = pa.array(row, pa.int32())
            chunks = pa.array(out, pa.string())
            tokens = pa.array([(len(c) + 3) >> 2 for c in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(which) for c in batch.columns[:n]), pa.array(page_no, pa.int32()),
                 pa.array(chunk_no, pa.int32()), chunks, tokens],
                [*batch.schema.names[:n], "page_idx", "chunk_idx", "chunk", "chunk_tokens"])


def chunk_documents(docs: DataFrame, limit: int = DEFAULT_CHUNK_TOKENS, *, text_col: str = "text",
                    key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """C1 + D1-D5 in one pass: docs(key, text) -> chunks(key, carry..., page_idx INT, chunk_idx INT,
    chunk, chunk_tokens), equal to ``chunk_pages(split_pages(docs))``.

    Texts cross to Python once and chunks come back as rows; no page or chunk array is built on
    either side. A NULL or blank text has no chunk (``document_status`` reports it)."""
    rows = docs.select(key, *carry, F.col(text_col).cast("string").alias("__text"))
    n, limit = 1 + len(carry), int(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunk_batches(batches, n, limit)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{head}, page_idx int, chunk_idx int, chunk string, chunk_tokens bigint")


CHUNK_KEYS = ("doc_id", "page_idx", "chunk_idx")


def chunk_pages(pages: DataFrame, limit: int = DEFAULT_CHUNK_TOKENS, *, page_col: str = "page",
                native: bool = False) -> DataFrame:
    """pages(doc_id, page_idx, page, ...) -> chunks(..., chunk_idx INT, chunk, chunk_tokens).

    Empty chunks are kept (X12). The fold is row-local, so no exchange is added;
    ``posexplode`` gives the dense 0-based chunk index per page.
    """
    if native:
        arr = chunk_array_native(pages, page_col, limit, "__chunks")
    else:
        arr = pages.withColumn("__chunks", chunk_array(page_col, limit))
    keep = [c for c in pages.columns if c != page_col]
    # posexplode_outer: a plain posexplode lets the optimizer infer a
    # size(chunks) > 0 filter below the generator, which evaluates the chunk
    # UDF a second time. The outer form emits one NULL row for a page without
    # chunks, dropped right after.
    return (
        arr.select(*keep, F.posexplode_outer("__chunks").alias("chunk_idx", "chunk"))
        .where(F.col("chunk_idx").isNotNull())
        .withColumn("chunk_idx", F.col("chunk_idx").cast("int"))
        .withColumn("chunk_tokens", approx_tokens("chunk"))
    )


def chunk_counts(pages: DataFrame, limit: int = DEFAULT_CHUNK_TOKENS, *, page_col: str = "page") -> DataFrame:
    """Chunks per page; a blank page has 0 chunks (explode_outer keeps it)."""
    from versio.functions.text import is_blank

    arr = F.when(is_blank(page_col), F.array().cast("array<string>")).otherwise(chunk_array(page_col, limit))
    return pages.select("doc_id", "page_idx", F.size(arr).cast("bigint").alias("n_chunks"))
