"""Periodic runs of words: passages that repeat a block of words over and over.

A run is a stretch of consecutive words whose smallest period is q, at least
max(min_words, min_repeats * q) words long, that no neighbouring word extends.
Each of its words occurs at least min_repeats times in it. So a word that occurs
more rarely in a segment belongs to no run of that segment and splits it; the
pieces are counted anew until nothing splits any more. What survives is scanned
lag by lag.

* Splitting: when a segment splits, the words of all pieces but the longest are
  counted (or taken off the counts that the longest inherits), so a word is
  looked at a logarithmic number of times however deep the recursion goes.
* Lag scan: at lag q a run has a stretch of at least 2q words that equal the
  word q further on, so it holds two equal neighbouring blocks that begin at a
  multiple of q. Only these blocks are compared, by prefix hashes: n log n
  comparisons for all lags of n words. What agrees is extended word by word, so
  a collision of hashes changes nothing.

Documents are rows and stay where they are; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of blocks compared at a time.
PAIRS = 1 << 18
#: Rows whose results are held at a time.
ROWS = 256
#: Modulus of the hashes (a prime, so that no regular text makes them collide).
PRIME = (1 << 31) - 1

Run = tuple[int, int, int]


def surviving(codes: np.ndarray, min_words: int, min_repeats: int) -> list[tuple[int, int]]:
    """Segments [start, end) of at least ``min_words`` words in which every word occurs at least ``min_repeats``
    times, after splitting at all rarer words again and again. ``codes``: a small whole number for each word."""
    if len(codes) < min_words:
        return []
    often = (np.bincount(codes) >= min_repeats)[codes]
    edges = np.flatnonzero(np.diff(often.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    first = [(a, b) for a, b in edges.tolist() if b - a >= min_words]
    if not first or first == [(0, len(codes))]:
        return first
    words, places = codes.tolist(), None
    done: list[tuple[int, int]] = []
    work: list[tuple[int, int, Counter, list[int] | None]] = [(a, b, Counter(words[a:b]), None) for a, b in first]
    while work:
        lo, hi, counts, rare = work.pop()
        if rare is None:
            rare = [w for w, c in counts.items() if c < min_repeats]
        if not rare:
            done.append((lo, hi))
            continue
        if places is None:  # of each word, in order
            places = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1])
            places = [p.tolist() for p in places]
        cuts = sorted(p for w in rare for p in places[w][bisect_left(places[w], lo):bisect_left(places[w], hi)])
        pieces = list(zip([lo, *(c + 1 for c in cuts)], [*cuts, hi], strict=True))
        longest = max(pieces, key=lambda p: p[1] - p[0])
        if longest[1] - longest[0] < min_words:
            continue
        gone = Counter(words[c] for c in cuts)
        for a, b in pieces:
            if (a, b) != longest and a < b:
                own = Counter(words[a:b])
                gone.update(own)
                if b - a >= min_words:
                    work.append((a, b, own, None))
        counts.subtract(gone)
        work.append((*longest, counts, [w for w in gone if 0 < counts[w] < min_repeats]))
    return sorted(done)


class _Cover:
    """Runs found so far, those inside another left out: sorted by start and so by end."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[i:j], self.ends[i:j] = [start], [end]


def lag_scan(codes: np.ndarray, sums: np.ndarray, powers: np.ndarray, lo: int, hi: int, min_words: int, min_repeats: int) -> list[Run]:
    """The runs (start, length, period) within the segment [lo, hi), by period, then start. ``sums``: prefix sums
    of word hashes times ``powers``, modulo PRIME."""
    size, found, cover = hi - lo, [], _Cover()
    lags = np.arange(1, size // min_repeats + 1)
    blocks = size // lags - 1  # neighbouring blocks at multiples of each lag
    ends = np.cumsum(blocks)
    at = 0
    while at < len(lags):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = blocks[at:to]
        lag = np.repeat(lags[at:to], n)
        number = np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n)
        here = lo + number * lag
        middle = sums[here + lag]
        equal = (middle - sums[here]) % PRIME * powers[lag] % PRIME == (sums[here + 2 * lag] - middle) % PRIME
        at = to
        hits = np.flatnonzero(equal)
        if not len(hits):
            continue
        lag, number, here = lag[hits], number[hits], here[hits]
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(lag) != 0) | (np.diff(number) != 1))))
        closes = np.concatenate((opens[1:], [len(hits)])) - 1
        for q, a, b in zip(lag[opens].tolist(), here[opens].tolist(), (here[closes] + 2 * lag[closes]).tolist(), strict=True):
            least = max(min_words, min_repeats * q)
            # inside a run of a smaller period the lag is a multiple of that period
            if b - a + 2 * q < least or cover.holds(a, b):
                continue
            if not np.array_equal(codes[a:b - q], codes[a + q:b]):  # hashes collided: look at what agrees in fact
                stretches = np.flatnonzero(np.diff((codes[lo:hi - q] == codes[lo + q:hi]).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans = [(lo + s, lo + e + q) for s, e in stretches.tolist()]
            else:
                left = codes[max(lo, a - q):a]
                differ = np.flatnonzero(left != codes[max(lo, a - q) + q:a + q])
                start = max(lo, a - q) + (int(differ[-1]) + 1 if len(differ) else 0)
                right = codes[b:min(hi, b + q)]
                differ = np.flatnonzero(right != codes[b - q:b - q + len(right)])
                spans = [(start, b + (int(differ[0]) if len(differ) else len(right)))]
            for start, end in spans:
                if end - start >= least and not cover.holds(start, end):
                    found.append((start, end - start, q))
                    cover.add(start, end)
    return sorted(set(found), key=lambda r: (r[2], r[0]))


def runs_of(words: Sequence[bytes], min_words: int = 24, min_repeats: int = 3) -> list[Run]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    if len(words) < min_words:
        return []
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    segments = surviving(codes, min_words, min_repeats)
    if not segments:
        return []
    draw = np.random.default_rng(len(words))  # hashes only say where to look
    base, powers = int(draw.integers(1 << 20, PRIME)), np.ones(1, np.int64)
    while len(powers) <= len(words):
        powers = np.concatenate((powers, powers * pow(base, len(powers), PRIME) % PRIME))
    values = draw.integers(1, PRIME, size=len(number))[codes]
    sums = np.concatenate(([0], np.cumsum(values * powers[:len(words)] % PRIME))) % PRIME
    found = [r for lo, hi in segments for r in lag_scan(codes, sums, powers, lo, hi, min_words, min_repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """One row for each row: the id, ``runs`` (array of start, length and period in words, by start, then period)
    and ``collapsed``, the words joined by single spaces without those that repeat: a word goes if any run
    holds it after that run's first period.

    Words are maximal stretches without ASCII white space, numbered from 0 over the whole text. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``. Rows are independent: repeated rows give repeated
    results, null ids stay null, an empty table gives no rows, and no other column is read. ``min_repeats`` is 3
    at least.
    """
    if min_repeats < 3 or min_words < 1:
        raise ValueError("min_repeats must be 3 or more and min_words 1 or more")
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(text: str | None) -> tuple[list[Run], str]:
        words = (text or "").encode().split()  # splits at ASCII white space
        runs = runs_of(words, min_words, min_repeats)
        if not runs:
            return runs, b" ".join(words).decode()
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        return runs, b" ".join(compress(words, keep.tolist())).decode()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [one(t.as_py()) for t in part.column(1)]
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in m[0]] for m in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array([m[1] for m in made], pa.string())], [part.schema.names[0], "runs", "collapsed"])

    head = f"`{id_col}` {picked.schema[0].dataType.simpleString()}"
    return picked.mapInArrow(scan, f"{head}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def best_run(runs: Column) -> Column:
    """Of an array of runs in order, that with the greatest length/period, compared exactly; the first of equal
    ones; null if there is none."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"

    def better(best: Column, run: Column) -> Column:
        more = best["start"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(kind), better)
