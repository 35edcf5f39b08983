"""BPE encoding and decoding with a public tokenizer's vocabulary file.

Words are merged with a segment tree over the ranks of adjacent pairs: a leaf
holds the rank of the pair that starts at its symbol, an inner node (of FAN
children) the smallest leaf below it, the leftmost on a tie. The root names the
next merge; a merge changes three leaves, each updated in logarithmic time,
until the root holds no rank. A word of n symbols so costs n log n, however
long it is.

The file (JSON of the tokenizers library) is read on the driver and broadcast:
its size is that of the vocabulary. Each Python worker parses it once and keeps
the ids of words it has met in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.functions.worker import worker_state

#: Children of a node of the segment tree.
FAN = 16
#: No pair.
NONE = 1 << 62
_LOW = (1 << 32) - 1
#: Words whose ids a worker keeps: two generations, each begun when the one before has this many characters.
KEPT_CHARS = 2_500_000
#: Words of a text that are looked up at a time.
BLOCK = 50_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is
    printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """Merge a word's symbols. ``ranks``: (left id << 32 | right id) to (rank, merged id).

    The leaves of the tree are numbers (rank << 32 | place), so that the smallest is the leftmost of
    the lowest rank; every node above holds the smallest of its FAN children."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    leaves = [found[0] << 32 | i if (found := get(symbols[i] << 32 | symbols[i + 1])) else NONE for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k:k + FAN]) for k in range(0, len(below), FAN)])
    top, above = levels[-1], list(zip(levels, levels[1:], strict=False))

    def lift(i: int) -> None:
        for below, level in above:
            i //= FAN
            least = min(below[i * FAN:(i + 1) * FAN])
            if level[i] == least:
                return
            level[i] = least

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := min(top)) < NONE:
        i = least & _LOW
        j = after[i]
        left = symbols[i] = ranks[symbols[i] << 32 | symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = get(left << 32 | symbols[k])
            leaves[i] = found[0] << 32 | i if found else NONE
            leaves[j] = NONE
        else:  # no pair starts at the last symbol
            leaves[i] = NONE
        if (p := before[i]) >= 0:
            found = get(symbols[p] << 32 | left)
            leaves[p] = found[0] << 32 | p if found else NONE
        if above:  # else the root is right above the leaves
            for at in {i, min(j, n - 2), max(p, 0)}:
                lift(at)
    return [s for s in symbols if s >= 0]


#: Up to U+02FF, text is in form NFC, lower-casing goes by single characters, and these are the letters and
#: numbers; typographic punctuation and signs of currency are neither and stay as they are. A text with any
#: other character goes through the library's own normaliser and splitter.
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LETTER = rf"[^\W\d_{_NUMBERS}]"
_SIMPLE = re.compile(rf"{_LETTER}+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|(?:(?!{_LETTER})[^ \t-\r\x85\xa0{_NUMBERS}])+")
_OTHER = re.compile("[^\x00-˿‐-‧‰-⁞₠-⃀]")
#: What the shortcut above stands for, as the vocabulary file states it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBpe:
    """Encoder and decoder of a vocabulary file of byte-level word BPE."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model["unk_token"] is not None or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE model without unknown token, dropout, byte fallback and prefixes is needed")
        if spec["decoder"] is not None:
            raise ValueError("a file without a decoder is needed")
        vocab, chars = model["vocab"], byte_chars()
        self.suffix = model["end_of_word_suffix"] or ""
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.suffix] for c in chars]
        self.ranks = {vocab[a] << 32 | vocab[b]: (r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        library = Tokenizer.from_str(content)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.simple = split["pattern"]["Regex"] == _PATTERN and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.raw_of = {ord(c): b for b, c in enumerate(chars)}
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.chars = 0

    def _merged(self, raw: bytes) -> list[int]:
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merge(symbols, self.ranks)

    def _learn(self, words: list[str]) -> None:
        """Have the ids of all ``words`` in the younger generation."""
        if self.chars >= KEPT_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        young, old = self.young, self.old
        for word in set(words).difference(young):
            ids = old.get(word)
            young[word] = self._merged(word.encode()) if ids is None else ids
            self.chars += len(word)

    def _plain(self, text: str, out: list[int]) -> None:
        """Append the ids of a text without special tokens."""
        if self.simple and not _OTHER.search(text):
            words = _SIMPLE.findall(text.lower())
        else:  # the library's words stand for bytes; as text they are looked up in the same table
            words = [w.translate(self.raw_of).encode("latin-1").decode() for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))] if text else []
        for at in range(0, len(words), BLOCK):
            part = words[at:at + BLOCK]
            self._learn(part)
            out.extend(chain.from_iterable(map(self.young.__getitem__, part)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens in it become those tokens."""
        out: list[int] = []
        at = 0
        for m in self.special_re.finditer(text) if self.special_re else ():
            self._plain(text[at:m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's text of ids for a file without a decoder: the tokens, separated by spaces; ids that
        are not in the vocabulary are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])

    def words(self, ids: Iterable[int]) -> str:
        """Readable text of ids: words as they were normalised, one space after each."""
        text = "".join(self.names[i] if i in self.special.values() else self.names[i].replace(self.suffix, " ") for i in ids)
        raw = b"".join(b" " if c == " " else bytes([self.byte_of[c]]) if c in self.byte_of else c.encode() for c in text)
        return raw.decode(errors="replace")


def model_of(content: bytes) -> WordBpe:
    """The model of a file's content, parsed once in each worker process."""
    kept, key = worker_state("bpe"), hashlib.sha256(content).hexdigest()
    if kept.get("key") != key:
        kept.update(key=key, model=WordBpe(content.decode()))
    return kept["model"]


def _mapped(docs: DataFrame, columns: list, schema: str, path: str, row: Callable) -> DataFrame:
    """``row(model, last column's value)`` for each row: its results follow the other columns."""
    with open(path, "rb") as f:  # the vocabulary is a parameter of the job, read where the job is set up
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    picked = docs.select(*columns)
    n = len(columns) - 1
    names = [c.split()[0] for c in schema.split(", ")]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what a batch returns may be longer than its texts
                part = batch.slice(at, 256)
                made = [row(model, v.as_py()) for v in part.column(n)]
                cols = list(zip(*made, strict=True)) if made else [()] * len(names)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*part.schema.names[:n], *names])

    kinds = [{"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in schema.split(", ")]
    return picked.mapInArrow(run, f"{head}, {schema}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id and ``ids``, the token ids of the whole text.

    A null text counts as empty and has no ids; so has a blank one. Rows are independent: repeated rows
    give repeated results, null ids stay null, an empty table gives no rows, and no other column is read.
    """
    cols = [F.col(id_col), F.col(text_col).cast("string").alias("text")]
    return _mapped(docs, cols, "ids array<int>", path, lambda m, t: (m.encode(t or ""),))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row: the id and ``decoded``, the text of the ids (null ids: the empty text)."""
    cols = [F.col(id_col), F.col(ids_col).alias("ids")]
    return _mapped(encoded, cols, "decoded string", path, lambda m, ids: (m.decode(ids or ()),))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: the id, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256``. Cases as in ``encode``; ids and texts are not shuffled."""
    def row(model: WordBpe, text: str | None) -> tuple:
        ids = model.encode(text or "")
        raw = np.array(ids, "<u4").tobytes()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    cols = [F.col(id_col), F.col(text_col).cast("string").alias("text")]
    return _mapped(docs, cols, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, row)
