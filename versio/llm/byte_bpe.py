"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The library splits a text by a pattern and merges each match on its own. A long
text is cut first, where a match ends whatever surrounds it:

* between a character that is not white space and white space, as no match goes
  on from the one to the other;
* before the last character of white space that a word follows, as the match of
  white space leaves that character to the word.

So the parts of a text have the ids of the text. Long stretches of white space,
on which the library's pattern runs out of stack, are a match of their own and
are merged without the pattern. Decoding joins the bytes of the ids, which need
not be whole characters.

The rank file is read on the driver and broadcast: its size is that of the
vocabulary. Each Python worker builds the encoder once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.functions.worker import worker_state

#: Texts up to this length are encoded in one call; longer ones in parts of about this length.
PART = 32_768
#: Stretches of white space from this length on are merged without the pattern.
LONG_SPACE = 1_024
#: Rows whose results are held at a time.
ROWS = 64

#: White space as the pattern means it (the Unicode property).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_LONG = re.compile(f"[{_SPACE}]{{{LONG_SPACE},}}")
#: Every alternative of a pattern that the cuts hold for.
_ALTERNATIVES = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"}


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """The text cut where matches end: (part, whether it is one match of white space)."""
    at, n = 0, len(text)
    for space in _LONG.finditer(text):
        start, end = space.span()
        if end < n:
            end -= 1  # the last one may belong to the word after it
        yield from _cut(text, at, start, size)
        yield text[start:end], True
        at = end
    yield from _cut(text, at, n, size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    while at < end:
        found = _SAFE.search(text, at + size, end) if end - at > size else None
        to = found.start() if found else end
        yield text[at:to], False
        at = to


class RankBpe:
    """Encoder and decoder of a rank file (lines of a token in base 64 and its rank)."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import tiktoken

        if set(pattern.split("|")) != _ALTERNATIVES:
            raise ValueError("the cuts are not known to be safe for this pattern")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        ordinary = self.library.encode_ordinary
        if len(text) <= PART:
            return np.array(ordinary(text), np.int32)
        piece = self.library._encode_single_piece  # merges its argument as one match
        return np.concatenate([np.array(piece(p) if is_space else ordinary(p), np.int32) for p, is_space in parts(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id that is not in the file is an error."""
        return self.library.decode_bytes(ids.tolist())


def model_of(content: bytes, pattern: str) -> RankBpe:
    """The model of a file's content, built once in each worker process."""
    kept, key = worker_state("rank bpe"), (hashlib.sha256(content).hexdigest(), pattern)
    if kept.get("key") != key:
        kept.update(key=key, model=RankBpe(content, pattern))
    return kept["model"]


def _mapped(rows: DataFrame, path: str, pattern: str, row: Callable[[RankBpe, pa.Scalar], object], added: str, kind: pa.DataType, sql: str) -> DataFrame:
    """All columns but the last, and ``added``: what ``row`` makes of the last one."""
    with open(path, "rb") as f:  # the ranks are a parameter of the job, read where the job is set up
        content = rows.sparkSession.sparkContext.broadcast(f.read())
    fields = rows.schema.fields[:-1]
    names = [*(f.name for f in fields), added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(content.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = pa.array([row(model, v) for v in part.column(len(fields))], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return rows.mapInArrow(run, f"{head}{added} {sql}")


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id and ``ids``, the token ids of the whole text, without special tokens.

    A null text counts as empty and has no ids. Rows are independent: repeated rows give repeated results, null
    ids stay null, an empty table gives no rows, and no other column is read. Texts may be of any length and
    hold any characters, in stretches of any length."""
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return _mapped(picked, path, pattern, lambda m, t: m.encode(t.as_py() or ""), "ids", pa.list_(pa.int32()), "array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row: the id, the columns ``keep`` and ``decoded``, the bytes of the ids (null ids: none)."""
    picked = encoded.select(id_col, *keep, F.col(ids_col).alias("ids"))

    def row(model: RankBpe, ids: pa.Scalar) -> bytes:
        return model.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else b""

    return _mapped(picked, path, pattern, row, "decoded", pa.binary(), "binary")
