"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over the bytes of every text (a byte counts for 32
positions). A chunk ends at the smallest hash of every ``WINDOW`` positions
(winnowing), so ends depend on nearby bytes alone: an insertion moves the
chunks behind it but does not change them. The key of a chunk is the digest of
the 32 bytes at its end. ``LEAST_WORDS`` words with what is between them are at
least 99 bytes, which hold a whole window: of a passage that two documents
share, each has a chunk end in every window, with the same keys, so it lies
within a run of shared keys and a margin on either side.

Runs whose words, margins included, reach ``least_words`` are looked at word by
word: every passage of exactly ``least_words`` words that begins in them is
hashed as it stands in the text, spacing included. One that several documents
hold is a repeat in all of them but the one with the smallest id, and repeats
that overlap form a span. The runs only say where to look; a span is made of
whole repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versio.llm.common import drop_written, fresh, join_keys, written

#: Random 32-bit number of each byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
#: Bytes over which the hash reaches.
HASHED = 32
LEAST_WORDS = 50
#: Positions of which the one with the smallest hash ends a chunk: with the bytes hashed at the first
#: of them they fit into the shortest passage (words of one byte).
WINDOW = 2 * LEAST_WORDS - HASHED
#: Words of 64 bits that tell which ids are looked at: at most this many rows are broadcast.
SLOTS = 1 << 16
#: Bytes that are hashed at a time.
PIECE = 1 << 20
#: Bytes by which a passage may begin before the first end of a chunk in it, and go on after the last one.
BEFORE, AFTER = HASHED + WINDOW + 3, WINDOW + 3


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] modulo 2^32 after each byte, by doubling."""
    h, step = GEAR[data], 1
    while step < HASHED:
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
        step *= 2
    return h


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, by doubling."""
    step, size = 1, len(h) - n + 1
    while 2 * step <= n:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:size], h[n - step:n - step + size])


def _thinned(ends: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """``ends`` without those in a row that have the same bytes before them, as far as every window
    keeps one of them: a text without variety has an end at every repetition otherwise."""
    grams = np.lib.stride_tricks.sliding_window_view(data, HASHED)
    same = np.zeros(len(ends) + 1, bool)
    for lo in range(1, len(ends), PIECE):
        hi = min(lo + PIECE, len(ends))
        same[lo:hi] = (grams[ends[lo:hi] - HASHED] == grams[ends[lo - 1:hi - 1] - HASHED]).all(axis=1)
    inner = same[:-1] & same[1:]
    if not inner.any():
        return ends
    kept, last, at = np.ones(len(ends), bool), 0, ends.tolist()
    for k in np.flatnonzero(inner).tolist():
        last = at[k - 1] if kept[k - 1] else last
        kept[k] = at[k + 1] - last > window
    return ends[kept]


def cuts(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions at which chunks end, the length of the data included."""
    n, found = len(data), [np.zeros(0, np.int64)]
    for lo in range(HASHED - 1, n - window + 1, PIECE):  # of windows that begin at lo and after
        start, end = lo - HASHED + 1, min(n, lo + PIECE + window - 1)
        h = gear_hash(data[start:end])[HASHED - 1:].astype(np.uint64)
        # of equal hashes the last one is the smallest
        least = _least((h << np.uint64(32)) | np.arange(len(h), 0, -1).astype(np.uint64), window)
        found.append(lo + len(h) - (np.unique(least) & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1)
    ends = np.unique(np.concatenate(found))
    if len(ends):
        ends = _thinned(ends, data, window)
    for _ in range(3):  # no character is cut
        inside = (ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80) if n else np.zeros(len(ends), bool)
        ends = ends + inside
    ends = np.unique(np.append(ends, n))
    return ends if n else ends[:0]


def _begun(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word begins, and whether one ends, at each byte (the last byte of the word)."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    return begins, stops


def chunk_table(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Key, end, size, words, words up to BEFORE bytes before the end and up to AFTER bytes behind it, of
    each chunk. A text that is shorter than any passage has none."""
    data = np.frombuffer(text, np.uint8)
    ends = cuts(data, window) if len(data) >= HASHED + window - 1 else np.zeros(0, np.int64)
    key = np.fromiter((xxhash.xxh3_64_intdigest(text[e - HASHED:e]) for e in ends.tolist()), np.uint64, len(ends))
    upto = np.concatenate([[0], np.cumsum(_begun(data)[0])])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    before = upto[ends] - upto[np.maximum(ends - BEFORE, 0)]
    after = upto[np.minimum(ends + AFTER, len(data))] - upto[ends]
    return key, ends, ends - starts, upto[ends] - upto[starts], before, after


#: Bits of end, size, words, words before and after in the long that carries a chunk's place.
_WIDTHS = (31, 8, 7, 7, 7)


def _packed(values: tuple[np.ndarray, ...]) -> np.ndarray:
    out = np.zeros(len(values[0]), np.int64)
    for v, width in zip(values, _WIDTHS, strict=True):
        out = (out << width) | np.minimum(v, (1 << width) - 1).astype(np.int64)
    return out


def _unpacked(place: Column) -> dict[str, Column]:
    out, below = {}, sum(_WIDTHS)
    for name, width in zip(("end", "size", "words", "before", "after"), _WIDTHS, strict=True):
        below -= width
        out[name] = F.shiftright(place, below).bitwiseAND(F.lit((1 << width) - 1))
    return out


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row``, ``text`` (bytes) of the rows with an id. ``row`` tells apart the different texts of one id: 0
    where an id has one text (so that it takes no room), else the hash of the text."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    mark = F.xxhash64("text")
    several = rows.groupBy("id").agg(F.min(mark).alias("least"), F.max(mark).alias("most")).where("least <> most").select("id", F.lit(True).alias("several"))
    told = join_keys(rows, several, ["id"], salt_by=mark)
    return told.select("id", F.when(F.col("several"), mark).otherwise(0).alias("row"), "text")


def chunks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row ``id``, ``row``, ``digest``, ``place`` for each chunk of ``texts`` (``place`` packs end, size and word counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                digest, *place = chunk_table(batch.column(2)[k].as_py() or b"", window)
                held.append((k, digest, _packed(tuple(place))))
                if sum(len(x[1]) for x in held) > 50_000 or k == batch.num_rows - 1:
                    which = np.repeat([x[0] for x in held], [len(x[1]) for x in held]).astype(np.int64)
                    at = pa.array(which)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([x[1] for x in held]).view(np.int64)), pa.array(np.concatenate([x[2] for x in held]))], ["id", "row", "digest", "place"])
                    held.clear()

    held: list[tuple] = []
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row bigint, digest bigint, place bigint")


def _looked_at(found: DataFrame, least_words: int) -> DataFrame:
    """One row ``own``, ``mark``, ``parts`` for each text (id and row) with runs of shared chunks that may hold a
    passage: where these begin and end."""
    shared = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("digest")
    place = Window.partitionBy("id", "row").orderBy("place")  # by end, since that is in the upper bits
    held = found.join(shared, "digest").select("id", "row", "place").withColumn("past", F.lag("place").over(place))
    held = held.select("id", "row", "place", _unpacked(F.col("past"))["end"].alias("past"), *[c.alias(k) for k, c in _unpacked(F.col("place")).items()])
    begins = F.coalesce(F.col("past") < F.col("end") - F.col("size"), F.lit(True))
    runs = held.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(place))
    # the words of the first chunk are counted twice: too many is safe
    words = F.sum("words") + F.max(F.when(F.col("begins") == 1, F.col("before"))) + F.max("after")
    parts = runs.groupBy("id", "row", "run").agg(words.alias("words"), F.min("end").alias("lo"), F.max("end").alias("hi")).where(F.col("words") >= least_words)
    return parts.groupBy(F.col("id").alias("own"), F.col("row").alias("mark")).agg(F.sort_array(F.collect_list(F.struct(F.col("lo") - BEFORE, F.col("hi") + AFTER))).alias("parts"))


def _passages(text: bytes, parts: list[tuple[int, int]], least_words: int) -> tuple[np.ndarray, ...]:
    """Digest, number of the first word, start and end of each passage of least_words words in the parts."""
    begins, stops = map(np.flatnonzero, _begun(np.frombuffer(text, np.uint8)))
    first, last = begins[:max(0, len(begins) - least_words + 1)], stops[least_words - 1:] + 1
    taken = np.zeros(len(first) + 1, np.int64)
    for lo, hi in parts:
        a, b = np.searchsorted(first, lo), np.searchsorted(last, hi, side="right")
        if a < b:
            taken[a] += 1
            taken[b] -= 1
    nth = np.flatnonzero(np.cumsum(taken)[:-1] > 0)
    first, last = first[nth], last[nth]
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(nth)).view(np.int64), nth, first, last


def _perhaps(rows: DataFrame, looked_at: DataFrame) -> DataFrame:
    """``rows`` without most of those that ``looked_at`` has nothing of, so that their texts need not move: a bit for
    the hash of each id, SLOTS words of 64 bits at most, whatever the number of ids."""
    def word(id_: str) -> Column:
        return F.xxhash64(id_).bitwiseAND(F.lit(SLOTS - 1))

    def bit(id_: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(id_), 58).cast("int")

    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit("own"))
    bits = written(looked_at.groupBy(word("own").alias("word")).agg(F.bit_or(one).alias("bits")), "looked-at-bits")
    held = F.call_function("shiftright", F.col("bits"), bit("id")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bits), word("id") == F.col("word")).where(held).drop("word", "bits")


def passages(rows: DataFrame, looked_at: DataFrame, least_words: int) -> DataFrame:
    """One row ``id``, ``row``, ``digest``, ``nth``, ``start``, ``stop`` for each passage of ``least_words`` words in the
    parts of ``texts`` to look at."""
    rows = _perhaps(rows, looked_at).join(looked_at, (F.col("id") == F.col("own")) & (F.col("row") == F.col("mark"))).select("id", "row", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py() or b""
                parts = [tuple(p.values()) for p in batch.column(3)[k].as_py()]
                found = _passages(text, parts, least_words)
                at = pa.array(np.full(len(found[0]), k, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x, pa.int64()) for x in found]], ["id", "row", "digest", "nth", "start", "stop"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row bigint, digest bigint, nth bigint, start bigint, stop bigint")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each span of a document that documents with smaller ids hold: the id, ``first_doc_id``
    (the smallest id that holds most of its passages), ``span_start`` and ``span_bytes`` (UTF-8, from 0),
    ``n_words`` and ``text_mark`` (0, or which of the different texts of one id it is in: their 64-bit hash).

    A span is made of all passages of ``least_words`` whole words, spacing included, that a document with
    a smaller id holds and that overlap; below 17 words, passages of less than HASHED bytes are not found. Only repeats across documents
    count: rows that repeat an id are one document, and rows with a null id take no part. Null, empty and
    short texts have no spans; texts of any length are looked at whole. Passages are told apart by 64
    bits. An empty table gives no rows; other columns are not read.
    """
    window = max(1, min(WINDOW, 2 * least_words - HASHED))
    rows = texts(docs, id_col, text_col)
    cut = written(chunks(rows, window), "chunks")  # chunks are cut once and read twice
    looked_at = written(_looked_at(cut, least_words), "looked-at")
    drop_written(cut)
    found = written(passages(rows, looked_at, least_words), "passages")
    # the rows of a digest are read in order of their ids, so the first one's is the smallest and none is held
    order = Window.partitionBy("digest").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = found.withColumn("first", F.min("id").over(order)).where("id <> first").select("id", "row", "first", "nth", "start", "stop")
    place = Window.partitionBy("id", "row").orderBy("nth")  # copies of a row only repeat each number
    begins = F.coalesce(F.lag("nth").over(place) + least_words <= F.col("nth"), F.lit(True))
    runs = again.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(place))
    ends = [F.min("nth").alias("nth"), F.max("nth").alias("until"), F.min("start").alias("start"), F.max("stop").alias("stop")]
    parts = runs.groupBy("id", "row", "run", "first").agg(F.count(F.lit(1)).alias("n"), *ends)
    most = F.max(F.struct(F.col("n"), (-F.col("first")).alias("back"))).alias("most")
    ends = [F.min("nth").alias("nth"), F.max("until").alias("until"), F.min("start").alias("start"), F.max("stop").alias("stop")]
    spans = parts.groupBy("id", "row", "run").agg(*ends, most)
    words = F.col("until") - F.col("nth") + least_words
    return spans.select(F.col("id").alias(id_col), (-F.col("most.back")).alias("first_doc_id"), F.col("start").alias("span_start"), (F.col("stop") - F.col("start")).alias("span_bytes"), words.alias("n_words"), F.col("row").alias("text_mark")).distinct()


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bytes of their spans taken out of the text; spans end between characters."""
    names = docs.columns
    own, cut, mark = fresh(names, "_id"), fresh(names, "_cut"), fresh(names, "_mark")
    lists = spans.groupBy(F.col(id_col).alias(own), F.col("text_mark").alias(mark)).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_bytes"))).alias(cut))
    raw = F.col(text_col).cast("binary")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.unhex(F.lit("")).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["kept"], F.substring(raw, (acc["at"] + 1).cast("int"), (s["span_start"] - acc["at"]).cast("int")))
        return F.struct((s["span_start"] + s["span_bytes"]).alias("at"), kept.alias("kept"))

    done = F.aggregate(cut, first, step)
    rest = F.substring(raw, (done["at"] + 1).cast("int"), F.octet_length(raw))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.concat(done["kept"], rest).cast("string"))
    same = (F.col(id_col) == F.col(own)) & ((F.col(mark) == 0) | (F.col(mark) == F.xxhash64(raw)))
    return docs.join(lists, same, "left").withColumn(text_col, text).select(*names)
