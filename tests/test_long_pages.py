"""Pages cut into blocks of lines against the chunker that sees whole pages."""

import random

import pytest
from pyspark.sql import functions as F

from versio.operators.chunk import chunk_pages, chunk_text_py
from versio.operators.long_pages import CLOSED, Block, chunk_long_pages, run_through


def some_page(rng, lines):
    shapes = [lambda: "", lambda: "x" * rng.randint(1, 30), lambda: "word " * rng.randint(1, 40), lambda: "y" * rng.randint(60, 900), lambda: " \t", lambda: "é" * 7]
    return "\n".join(rng.choice(shapes)() for _ in range(lines))


def in_blocks(page, limit, size):
    lines, entry, number, pieces = page.split("\n"), CLOSED, 0, {}
    for at in range(0, len(lines), size):
        block = Block(lines[at:at + size], limit)
        for chunk, whole, text in block.pieces(entry, number):
            assert not (whole and chunk in pieces)
            pieces.setdefault(chunk, []).append(text)
        count, entry = run_through(entry, block.table())
        number += count
    assert sorted(pieces) == list(range(number))
    return ["\n".join(pieces[k]) for k in range(number)]


@pytest.mark.parametrize("limit", [1, 2, 5, 20, 200, 10**9])
def test_blocks_of_any_size_give_the_chunks(limit):
    rng = random.Random(limit)
    for _ in range(60):
        page = some_page(rng, rng.randint(1, 60))
        want = chunk_text_py(page, limit)
        for size in (1, 2, 3, 7, 100):
            assert in_blocks(page, limit, size) == want, (page, size)


def test_a_table_says_what_the_block_does():
    rng = random.Random(4)
    for _ in range(100):
        block = Block(some_page(rng, rng.randint(1, 25)).split("\n"), 20)
        table = block.table()
        for entry in [CLOSED, *range(21)]:
            begun, used = 0, entry
            for s, (a, b) in enumerate(block.stretches):
                if s:
                    begun, used = begun + len(chunk_text_py(block.lines[a - 1], 20)), CLOSED
                opened = block.breaks(a, b, used)
                begun, used = begun + len(opened), block.left_open(a, b, used, opened)
            assert run_through(entry, table) == (begun, used)


@pytest.mark.parametrize("limit", [1, 20, 200])
def test_one_page_over_many_blocks(spark, limit):
    rng = random.Random(9)
    rows = [(1, 0, some_page(rng, 3000).strip()), (1, 1, "short"), (2, 0, some_page(rng, 40).strip()), (None, 0, "a\n" * 50 + "b")]
    pages = spark.createDataFrame(rows, "doc_id long, page_idx int, page string")
    lines = pages.select("doc_id", "page_idx", F.posexplode(F.split("page", "\n", -1)).alias("line_no", "line"))
    got = chunk_long_pages(lines, limit, block_lines=64)
    want = chunk_pages(pages, limit)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert chunk_long_pages(lines.limit(0), limit).count() == 0
