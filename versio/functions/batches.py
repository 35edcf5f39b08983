"""Pieces of Arrow batches: what a Python worker holds as Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of a piece.
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20


def pieces(batch: pa.RecordBatch, least: int = 1, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces, in order: at most ``rows`` rows and ``size`` bytes each, unless half of it had fewer than
    ``least`` rows."""
    n = batch.num_rows
    if n >= 2 * least and (n > rows or batch.nbytes > size):
        for part in (batch.slice(0, n // 2), batch.slice(n // 2)):
            yield from pieces(part, least, rows, size)
    elif n:
        yield batch
