"""Chunking a page that is larger than a task (D1-D5 over line rows).

A page comes as rows (key, page_idx, line_no, line) and is cut into blocks of lines. Greedy packing runs through a
page from its first line to its last, but all that a block has to know of the lines before it is how many tokens the
open chunk holds (or that none is open). So

1. each block is packed for every such entry at once: the first break depends on the entry alone and is found in the
   prefix sums of the costs; from a line that opens a chunk the next break is one jump on, and the jumps are followed
   once, from the last line back. A block becomes a short table: tokens on entry -> chunks begun, tokens on exit;
2. the tables of a page are run through in order, a few numbers a block;
3. with its entry and its first chunk number known, each block writes its chunks; those that go on over the edge of a
   block are put together from their pieces.

Step 1 and 3 run in parallel over the blocks of one page. The chunks are those of ``chunk_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.functions.text import DEFAULT_CHUNK_TOKENS, approx_tokens, py_approx_tokens
from versio.operators.chunk import chunk_text_py
from versio.session import written

#: Lines of a block.
BLOCK_LINES = 4096
#: No chunk is open.
CLOSED = -1


class Block:
    """The lines of a block as stretches of short lines between long ones."""

    def __init__(self, lines: list[str], limit: int) -> None:
        self.lines, self.limit = lines, limit
        costs = [py_approx_tokens(x) for x in lines]
        self.long = [k for k, c in enumerate(costs) if c >= limit]
        edges = [-1, *self.long, len(lines)]
        self.stretches = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
        self.sums = np.concatenate(([0], np.cumsum(np.minimum(costs, limit)))).astype(np.int64)  # long lines are never added up

    def breaks(self, start: int, end: int, used: int) -> list[int]:
        """Lines of a stretch that open a chunk, if ``used`` tokens are in the open one (CLOSED: none is)."""
        out, sums = [], self.sums
        if used == CLOSED:
            if start == end:
                return out
            out.append(start)
            used = 0
        at = start
        while True:
            at = int(np.searchsorted(sums, sums[at] + self.limit - used, side="right")) - 1
            if at >= end:
                return out
            out.append(at)
            used = 0

    def left_open(self, start: int, end: int, used: int, opened: list[int]) -> int:
        """Tokens in the open chunk after a stretch."""
        if opened:
            return int(self.sums[end] - self.sums[opened[-1]])
        return used if used == CLOSED else int(used + self.sums[end] - self.sums[start])

    def table(self) -> tuple[list[int], list[int], list[int], int, int, int, int | None]:
        """The block for every entry: ``above``, ``begun`` and ``exits`` (an entry of more than ``above`` tokens breaks at
        a line from which so many chunks are begun, leaving so many tokens; descending), the tokens of the first
        stretch (for entries that do not break), chunks begun from a closed entry, its exit, the chunks begun in
        the rest of the block, and the exit of the block if a long line makes it the same for every entry."""
        (start, end), sums, limit = self.stretches[0], self.sums, self.limit
        n = end - start
        nexts = np.searchsorted(sums, sums[start:end] + limit, side="right") - 1 if n else np.zeros(0, np.int64)
        begun, exits = np.ones(n, np.int64), sums[end] - sums[start:end]
        for k in range(n - 1, -1, -1):  # where each jump leads is known before it
            j = int(nexts[k]) - start
            if j < n:
                begun[k], exits[k] = 1 + begun[j], exits[j]
        grows = np.flatnonzero((np.diff(sums[start:end + 1]) > 0) & (sums[start:end] - sums[start] <= limit))
        above = limit - (sums[start + 1 + grows] - sums[start])
        closed = self.breaks(start, end, CLOSED)
        rest, exit_ = 0, None
        if self.long:
            for k, (a, b) in zip(self.long, self.stretches[1:], strict=True):
                opened = self.breaks(a, b, CLOSED)
                rest += len(chunk_text_py(self.lines[k], self.limit)) + len(opened)
                exit_ = self.left_open(a, b, CLOSED, opened)
        return (above.tolist(), begun[grows].tolist(), exits[grows].tolist(), int(sums[end] - sums[start]), len(closed),
                self.left_open(start, end, CLOSED, closed), rest, exit_)

    def pieces(self, entry: int, number: int) -> Iterator[tuple[int, bool, str]]:
        """(chunk number, whether the chunk is whole, text) of the block's chunks, if ``number`` were begun before."""
        used, last = entry, len(self.stretches) - 1
        for s, (start, end) in enumerate(self.stretches):
            if s:
                used = CLOSED
                for text in chunk_text_py(self.lines[start - 1], self.limit):
                    yield number, True, text
                    number += 1
            opened = self.breaks(start, end, used)
            first = opened[0] if opened else end
            if used != CLOSED and first > start:  # goes on with the chunk that came in
                yield number - 1, False, "\n".join(self.lines[start:first])
            for a, b in zip(opened, [*opened[1:], end], strict=False):
                # the last chunk may go on in the next block
                yield number, not (s == last and b == end), "\n".join(self.lines[a:b])
                number += 1


def run_through(entry: int, table: tuple) -> tuple[int, int]:
    """(chunks begun, exit) of a block's table for an entry."""
    above, begun, exits, total, closed_begun, closed_exit, rest, fixed = table
    if entry == CLOSED:
        count, out = closed_begun, closed_exit
    else:
        lo, hi = 0, len(above)  # the first threshold that the entry is over; they descend
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if above[mid] < entry else (mid + 1, hi)
        count, out = (begun[lo], exits[lo]) if lo < len(above) else (0, entry + total)
    return count + rest, out if fixed is None else fixed


def chunk_long_pages(lines: DataFrame, limit: int = DEFAULT_CHUNK_TOKENS, *, key: str = "doc_id", block_lines: int = BLOCK_LINES) -> DataFrame:
    """lines(key, page_idx, line_no, line) -> chunks(key, page_idx, chunk_idx INT, chunk, chunk_tokens), the chunks of
    ``chunk_pages`` for pages of any number of lines. ``line_no`` orders a page's lines, numbered from any number
    on without large gaps; a line must fit in a row."""
    limit = int(limit)
    rows = lines.select(F.col(key).alias("k"), "page_idx", F.floor(F.col("line_no") / block_lines).cast("bigint").alias("block"), F.struct("line_no", "line").alias("x"))
    whole = rows.groupBy("k", "page_idx", "block").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.coalesce(x["line"], F.lit(""))).alias("lines"))
    blocks = written(whole, "page-blocks")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields[:3])
    names = ["above", "begun", "exits", "total", "closed_begun", "closed_exit", "rest", "fixed"]
    kinds = [pa.list_(pa.int64())] * 3 + [pa.int64()] * 5

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = Block(batch.column(3)[k].as_py(), limit).table()
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:3]), *(pa.array([v], t) for v, t in zip(made, kinds, strict=True))], [*batch.schema.names[:3], *names])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entry, number, begun = None, CLOSED, 0, False
        for batch in batches:
            entries, numbers = [], []
            for k, page, *_, table in zip(*(batch.column(c).to_pylist() for c in range(3)), zip(*(batch.column(c).to_pylist() for c in range(3, 11)), strict=True), strict=True):
                if not begun or (k, page) != now:
                    now, entry, number, begun = (k, page), CLOSED, 0, True
                entries.append(entry)
                numbers.append(number)
                count, entry = run_through(entry, table)
                number += count
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(entries, pa.int64()), pa.array(numbers, pa.int64())], ["own", "page", "at", "entry", "number"])

    found = blocks.mapInArrow(tables, f"{head}, above array<bigint>, begun array<bigint>, exits array<bigint>, " + ", ".join(f"{n} bigint" for n in names[3:]))
    arranged = found.repartition(F.col("k"), F.col("page_idx")).sortWithinPartitions("k", "page_idx", "block")
    types = [f.dataType.simpleString() for f in blocks.schema.fields[:3]]
    entries = arranged.mapInArrow(through, f"own {types[0]}, page {types[1]}, at {types[2]}, entry bigint, number bigint")
    same = F.col("k").eqNullSafe(F.col("own")) & F.col("page_idx").eqNullSafe(F.col("page")) & (F.col("block") == F.col("at"))
    ready = blocks.join(entries, same).select("k", "page_idx", "block", "lines", "entry", "number")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = list(Block(batch.column(3)[k].as_py(), limit).pieces(batch.column(4)[k].as_py(), batch.column(5)[k].as_py()))
                at = pa.array([k] * len(made), pa.int32())
                cols = list(zip(*made, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:3]), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.string()), strict=True))],
                                                 [*batch.schema.names[:3], "chunk_idx", "whole", "chunk"])

    pieces = written(ready.mapInArrow(emit, f"{head}, chunk_idx bigint, whole boolean, chunk string"), "page-pieces")
    part = F.sort_array(F.collect_list(F.struct("block", "chunk")))
    over = pieces.where("not whole").groupBy("k", "page_idx", "chunk_idx").agg(F.array_join(F.transform(part, lambda x: x["chunk"]), "\n").alias("chunk"))
    done = pieces.where("whole").select("k", "page_idx", "chunk_idx", "chunk").unionByName(over)
    return done.select(F.col("k").alias(key), "page_idx", F.col("chunk_idx").cast("int").alias("chunk_idx"), "chunk", approx_tokens("chunk").alias("chunk_tokens"))
