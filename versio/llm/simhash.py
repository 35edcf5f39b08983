"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

A document's fingerprint has 64 bits; bit j is set when more than half of the
hashes of its word shingles have it. Two fingerprints link when they differ in
at most ``max_bits`` bits, and a component is what links reach.

Candidates come from the pigeonring principle (Qin and Xiao, 2018). Cut the 64
bits into m = max_bits + 1 segments around a ring. If two fingerprints differ
in at most t = max_bits bits, some start i exists from which every chain of l
consecutive segments differs in at most floor(l * t / m) bits. So the first
segment of the chain is equal and the second differs in at most one bit, which
leaves one of its halves equal: segment and half are the join key (two keys
for each start). Within a bucket, a pair has to keep the budget of every
further chain length from that start before all its 64 bits are compared.

Hot buckets: up to ``dense`` fingerprints (distinct ones; copies are folded
before) are compared in one task, which emits a spanning forest of their links
instead of pairs. A longer bucket is not compared at all: two fingerprints
differ in at most t bits exactly if a third point lies within floor(t/2) bits
of one and ceil(t/2) bits of the other, so each fingerprint of a long bucket
is sent to the points around it and links to the smallest one met there. That
is linear in the bucket and loses no link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import join_keys, unsent, written
from versio.llm.components import connected_components

HASH_SEED = 42
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 15
#: Longest bucket whose fingerprints are compared in one task.
DENSE = 512
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece at a time."""
    at, text = 0, text.lower()  # of bytes: A-Z only
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()  # of bytes: at space, \t, \n, \v, \f and \r
        at = end


def fingerprint(text: bytes | None, words: int) -> int:
    """SimHash of a text over shingles of ``words`` words, as an unsigned 64-bit integer."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest

    def add(shingles: list[bytes]) -> int:
        for k in range(0, len(shingles), BLOCK):
            part = shingles[k:k + BLOCK]
            h = np.fromiter((hashed(s, HASH_SEED) for s in part), "<u8", len(part))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add(counts, bits.sum(axis=0, dtype=np.uint32), out=counts)
        return len(shingles)

    for piece in _word_pieces(text or b""):
        tail += piece
        if len(tail) >= words:
            n += add([b" ".join(s) for s in zip(*(tail[k:] for k in range(words)), strict=False)])
            tail = tail[len(tail) - words + 1:]
    if not n and tail:
        n = add([b" ".join(tail)])
    return int(sum(1 << j for j in range(64) if 2 * counts[j] > n)) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3) -> DataFrame:
    """One row ``id``, ``fp`` (the 64 bits as a signed long) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the max_bits + 1 segments of the ring."""
    m = max_bits + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(fp: Column, max_bits: int) -> Column:
    """The bucket keys of a fingerprint: for each start, its segment and either half of the next one."""
    ring, keys = segments(max_bits), []
    for i, (offset, width) in enumerate(ring):
        after, more = ring[(i + 1) % len(ring)]
        low = more // 2
        for h, (at, wide) in enumerate(((after, low), (after + low, more - low))):
            key = F.shiftleft(_bits(fp, offset, width), 16).bitwiseOR(_bits(fp, at, wide))
            keys.append(key.bitwiseOR(F.lit((2 * i + h) << 49)))
    return F.array(*keys)


def chain_forest(fps: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Links among the distinct fingerprints of one bucket as a spanning forest: pairs that keep the
    budget of every chain from ``start`` and then differ in at most max_bits of all 64 bits."""
    ring, fps = segments(max_bits), fps.view(np.uint64)
    m, root, out = len(ring), list(range(len(fps))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(1, len(fps)):
        diff = fps[:k] ^ fps[k]
        alive, spent = np.arange(k), np.zeros(k, np.int64)
        for length in range(1, m):
            offset, width = ring[(start + length - 1) % m]
            part = (diff[alive] >> np.uint64(offset)) & np.uint64((1 << width) - 1)
            spent = spent[: len(alive)] + np.bitwise_count(part)
            held = spent <= length * max_bits // m
            alive, spent = alive[held], spent[held]
        for j in alive[np.bitwise_count(diff[alive]) <= max_bits].tolist():
            a, b = find(k), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((k, j))
    signed = fps.view(np.int64)
    return [(int(signed[k]), int(signed[j])) for k, j in out]


def _sparse_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for key, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                links += chain_forest(np.sort(fps.values.to_numpy()), key >> 50, max_bits)
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint")


def _dense_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``fps`` through the points around each: the smallest fingerprint within
    floor(max_bits/2) bits of a point links to all within ceil(max_bits/2) bits of it."""
    inner, outer = max_bits // 2, (max_bits + 1) // 2
    flips = [sum(1 << j for j in c) for r in range(outer + 1) for c in combinations(range(64), r)]
    near = sum(1 for f in flips if f.bit_count() <= inner)
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    flip = F.posexplode(F.array(*map(F.lit, signed)))
    points = fps.select("fp", flip.alias("nth", "flip")).select("fp", (F.col("nth") < near).alias("inner"), F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    centre = points.where("inner").groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    if inner == outer:  # the points that only one fingerprint reaches link nothing
        centre = centre.where("a <> z")
    return points.join(unsent(centre.drop("z")), "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints ``fp`` (each once) whose components are those
    of all pairs that differ in at most ``max_bits`` bits."""
    keyed = fps.select("fp", F.explode(ring_keys(F.col("fp"), max_bits)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(join_keys(keyed, shared, ["key"], salt_by=F.xxhash64("fp"), how="inner"), "buckets")
    sparse = members.where(F.col("n") <= dense).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    crowd = members.where(F.col("n") > dense).select("fp").distinct()
    return _sparse_links(sparse, max_bits).union(_dense_links(crowd, max_bits))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """One row for each row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``,
    the smallest id whose fingerprint links reach.

    A null or blank text has fingerprint zero, which links like any other. A text with fewer words
    than a shingle is one shingle. Rows with a null id take part in linking; their component is the
    smallest id reached, null if none has an id. Repeated rows give repeated results, an empty table
    none. Other columns are not read. ``max_bits`` from 0 to 7.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7")
    found = written(fingerprints(docs, id_col, text_col, words=words), "fingerprints")
    n = found.count()
    each = found.groupBy("fp").agg(F.min("id").alias("least"))
    if max_bits:
        roots = connected_components(links(each.select("fp"), max_bits, dense))
        each = each.join(unsent(roots, n), each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        each = each.join(unsent(each.groupBy("root").agg(F.min("least").alias("component")), n), "root").select("fp", "component")
    else:
        each = each.withColumnRenamed("least", "component")
    return found.join(unsent(each, n), "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
