"""Token-limited chunking - edge fixtures, properties, differential."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versio.operators.chunk import chunk_array, chunk_array_native, chunk_pages, chunk_text_py
from versio.operators.pages import split_pages

# Edge texts for limit 10 (FIXTURES.md section 3).
EDGES = {
    2: ("aaaa\n\n" + "x" * 60 + "\n\n" + "y " * 40 + "\n\n\nend",
        ["aaaa\n", "", "x" * 60, ""] + [" ".join(["y"] * 10)] * 4 + ["\n\nend"]),
    3: ("w" * 50 + " b c", ["", "w" * 50, "b c"]),
    4: ("a b" * 30, ["a" + " ba" * 9] + [" ".join(["ba"] * 10)] * 2 + ["b"]),
    6: ("h\n" + " " * 100 + "\nk", ["h", "k"]),
    7: (("abc def " * 5).strip(), ["abc def abc def abc def abc def abc def"]),
    10: ("aaaa\r\nbb\tcc", ["aaaa\r\nbb\tcc"]),
    11: ("\n".join(["abcd"] * 12), ["\n".join(["abcd"] * 10), "abcd\nabcd"]),
    12: ("one two\n\n\n\nthree", ["one two\n\n\n\nthree"]),
    13: ("q" * 44, ["", "q" * 44]),
    14: ("p" * 36 + " " + "r" * 60 + " s", ["p" * 36, "r" * 60, "s"]),
    15: ("x" * 39 + "\nabcd\nabcd", ["x" * 39, "abcd\nabcd"]),
    16: ("q" * 40 + "\n\n\n" + "q" * 40, ["", "q" * 40, "\n", "", "q" * 40]),
}


@pytest.mark.parametrize("key", sorted(EDGES))
def test_python_helper_edges(key):
    text, expected = EDGES[key]
    assert chunk_text_py(text, 10) == expected


def test_spark_edges_both_implementations(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in EDGES.items()], "doc_id long, page string")
    arrow = {r.doc_id: r.c for r in df.select("doc_id", chunk_array("page", 10).alias("c")).collect()}
    native = {r.doc_id: r.chunks for r in chunk_array_native(df, "page", 10).select("doc_id", "chunks").collect()}
    for k, (_, expected) in EDGES.items():
        assert arrow[k] == expected, k
        assert native[k] == expected, k


def test_pages_then_chunks_fixture_1_and_5(spark):
    docs = spark.createDataFrame([(1, "  <<<PAGE_BREAK>>>  "), (5, " pad <<<PAGE_BREAK>>>q")], "doc_id long, text string")
    rows = chunk_pages(split_pages(docs), 10).orderBy("doc_id", "page_idx", "chunk_idx").collect()
    assert [(r.doc_id, r.page_idx, r.chunk_idx, r.chunk) for r in rows] == [(5, 0, 0, "pad"), (5, 1, 0, "q")]


def _costs_ok(chunk: str, limit: int) -> bool:
    """A chunk of several atoms never has a cost sum over the limit."""
    lines = chunk.split("\n")
    if len(lines) > 1:
        return sum(math.ceil(len(l) / 4) for l in lines) <= limit
    ws = chunk.split(" ")
    if len(ws) > 1 and all(ws):
        line_cost = math.ceil(len(chunk) / 4)
        word_cost = sum(math.ceil((len(w) + 1) / 4) for w in ws)
        return line_cost <= limit or word_cost <= limit
    return True


text_st = st.text(alphabet=st.sampled_from(list("ab cd\n\t xyz")), max_size=300)


@settings(max_examples=300, deadline=None)
@given(text_st, st.integers(min_value=1, max_value=30))
def test_properties(text, limit):
    chunks = chunk_text_py(text, limit)
    squash = lambda s: "".join(s.split())
    assert squash("".join(chunks)) == squash(text)
    assert all(_costs_ok(c, limit) for c in chunks)


def test_native_twin_equals_arrow_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("page"))
    for limit in (20, 200, 2000):
        both = chunk_array_native(docs, "page", limit, "n").select("n", chunk_array("page", limit).alias("a"))
        assert both.where("n <> a").count() == 0


def test_any_partition_count_gives_equal_output(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = chunk_pages(split_pages(docs.repartition(1)), 50).collect()
    b = chunk_pages(split_pages(docs.repartition(7)), 50).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    keys = {}
    for r in a:
        keys.setdefault((r.doc_id, r.page_idx), []).append(r.chunk_idx)
    assert all(sorted(v) == list(range(len(v))) for v in keys.values())


def test_chunks_of_long_documents_come_back_in_small_batches():
    import pyarrow as pa

    from versio.operators.chunk import _chunk_batches

    texts = [f"{k} " + "word " * 200_000 for k in range(40)] + [None, ""]
    batch = pa.record_batch({"doc_id": list(range(42)), "text": texts})
    out = list(_chunk_batches(iter([batch, batch.slice(0, 0)]), 1, 200))
    assert max(b.nbytes for b in out) < 8 << 20
    got = [(d, i, c) for b in out for d, i, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "chunk_idx", "chunk")))]
    assert got == [(d, i, c) for d, t in enumerate(texts) for i, c in enumerate(chunk_text_py(t.strip(), 200) if t else [])]
