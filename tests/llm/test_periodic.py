"""Periodic runs against a direct scan of every lag."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as E
from versio.llm.periodic import periodic_runs, runs_of, surviving

SF = "/root/testdata/sf0.001"


def direct(words, least=24, repeats=3):
    """Every stretch that agrees with itself q words on, unless a smaller period fits it too."""
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(least, repeats * q) and all(words[start:end - p] != words[start + p:end] for p in range(1, q)):
                found.append((start, end - start, q))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k, out = rng.choice([1, 2, 2, 3, 5, 30]), []
    for _ in range(rng.randint(1, 4)):
        block = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 12))]
        out += (block * rng.randint(1, 30))[:rng.randint(1, 120)] if rng.random() < 0.6 else block
    return out


def test_runs_of_random_words():
    rng, met = random.Random(11), 0
    for _ in range(1500):
        words, least = some_words(rng), rng.choice([24, 24, 6, 10])
        want = direct(words, least)
        assert runs_of(words, least) == want, words
        met += len(want)
    assert met > 1000


def test_runs_at_the_limits():
    a, b, c = ([b"%s%d" % (x, k) for k in range(8)] for x in (b"a", b"b", b"c"))
    assert runs_of(a * 3) == [(0, 24, 8)]
    assert runs_of((a * 3)[:23]) == []
    assert runs_of([b"w"] * 23) == [] and runs_of([b"w"] * 24) == [(0, 24, 1)]
    nine = [*a, b"x"]
    assert runs_of(nine * 3) == [(0, 27, 9)] and runs_of((nine * 3)[:26]) == []
    assert runs_of(b + nine * 3 + c) == [(8, 27, 9)]
    # neighbours that go on for a while belong to the run
    assert runs_of(nine[5:] + nine * 3 + nine[:2] + c) == [(0, 33, 9)]
    # two runs that share words
    assert runs_of([b"x"] * 30 + [b"y", b"x"] * 20) == [(0, 30, 1), (29, 41, 2)]


def test_splitting_goes_on_until_nothing_is_rare():
    import numpy as np

    # each cut makes the next word rare
    n = 3000
    words = [*range(n), *range(1, n), *range(2, n + 1)]
    codes = np.array(words)
    assert surviving(codes, 24, 3) == []
    assert surviving(np.array([7] * 30 + [1, 2] + [8] * 30), 24, 3) == [(0, 30), (32, 62)]
    assert surviving(np.array([], int), 24, 3) == []


def test_long_texts_take_n_log_n():
    words = [b"a"] * 400_000
    assert runs_of(words) == [(0, 400_000, 1)]
    marks = [b"%d" % (bin(i).count("1") & 1) for i in range(1 << 16)]  # no block of it occurs three times in a row
    assert runs_of(marks) == []


def test_cases(spark):
    row = "w " * 30
    rows = [(1, row, 5), (1, row, 5), (None, "a b", 5), (2, None, 5), (3, "", 5), (4, " \t\n", 5), (5, "x y  \x1c " * 30, 5), (6, "v " * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    got = sorted(periodic_runs(docs).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, [tuple(x) for x in r.runs]) for r in got] == [
        (None, []), (1, [(0, 30, 1)]), (1, [(0, 30, 1)]), (2, []), (3, []), (4, []), (5, [(0, 60, 2)]), (6, [(0, 200_000, 1)])]
    assert [r.collapsed for r in got] == ["a b", "w", "w", "", "", "", "x y  \x1c", "v"]
    assert periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, min_repeats=2)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = direct(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *facts, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_op11_equals_plain_python(spark):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    want = {d: expected(d, t) for d, t in docs}
    assert got == want and sum(w[0] for w in want.values()) > 10
