"""B1-B8 (extraction) and C1-C6 (pages)."""

from versio.functions.text import PAGE_SUFFIX
from versio.operators.checks import document_status, strict
from versio.operators.extract import (PyExtractor, choose_best, extract_binary, html_best, html_candidates,
                                      mark_pages)
from versio.operators.pages import full_text_units, no_page_documents, page_counts, split_pages

import pytest


def _cands(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, method string, priority int, text string, error string")


def test_choose_best_fixtures(spark):
    M = PAGE_SUFFIX
    rows = [
        (1, "native", 1, "n" * 10, None), (1, "ocr", 2, "o" * 12, None), (1, "markdown", 3, "m" * 11, None),
        (2, "native", 1, "n" * 10, None), (2, "ocr", 2, "o" * 10, None), (2, "markdown", 3, "m" * 9, None),
        (3, "native", 1, "n" * 5 + " " * 20, None), (3, "ocr", 2, "o" * 6, None), (3, "markdown", 3, "", None),
        (4, "native", 1, "".join("x" + M for _ in range(10)), None), (4, "ocr", 2, "", None),
        (4, "markdown", 3, "m" * 100, None),
        (5, "native", 1, "   ", None), (5, "ocr", 2, "", None), (5, "markdown", 3, "", None),
    ]
    got = {r.doc_id: r for r in choose_best(_cands(spark, rows)).collect()}
    assert [got[i].method for i in (1, 2, 3, 4)] == ["ocr", "native", "ocr", "native"]
    assert len(got[4].text.strip()) == 189
    assert got[5].status == "empty_extraction" and got[1].status == "ok"


def test_html_extractors(spark):
    html = ('<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><a href="/x">Nav</a></nav>'
            '<article><h1>Head</h1><p>One &amp; two</p><p>Three</p></article><footer>&copy; F</footer></body></html>')
    df = spark.createDataFrame([(7, html)], "page_id long, html string")
    c = {r.method: r.text for r in html_candidates(df).collect()}
    assert c["article"] == "Head\n\nOne & two\n\nThree" + PAGE_SUFFIX
    assert c["native"].count("<<<PAGE_BREAK>>>") == 4 and "var a" not in c["native"]
    assert "# Head" in c["markdown"] and "[Nav](/x)" in c["markdown"] and "<<<" not in c["markdown"]
    best = html_best(df).first()
    assert best.method == max(c, key=lambda m: (len(c[m].strip()), -["native", "article", "markdown"].index(m)))


def test_binary_hook_keeps_partial_text(spark):
    def pages(blob):
        for part in blob.decode().split("\f"):
            if part == "BAD":
                raise ValueError("broken page")
            yield part

    files = spark.createDataFrame([(1, bytearray(b" a \fb\fBAD\fc"))], "doc_id long, content binary")
    ex = [PyExtractor("native", 1, pages), PyExtractor("markdown", 3, lambda b: [b.decode()], paged=False)]
    got = {r.method: r for r in extract_binary(files, ex).collect()}
    assert got["native"].text == "a" + PAGE_SUFFIX + "b" + PAGE_SUFFIX and "broken" in got["native"].error
    assert got["markdown"].text == " a \fb\fBAD\fc"


def test_mark_then_split_round_trip(spark):
    rows = [(1, 2, " c "), (1, 0, "a"), (1, 1, "   "), (2, 0, "z")]
    pr = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    marked = {r.doc_id: r.text for r in mark_pages(pr).collect()}
    assert marked[1] == "a" + PAGE_SUFFIX + PAGE_SUFFIX + "c" + PAGE_SUFFIX
    docs = spark.createDataFrame(list(marked.items()), "doc_id long, text string")
    got = sorted((r.doc_id, r.page_idx, r.page) for r in split_pages(docs).collect())
    assert got == [(1, 0, "a"), (1, 1, "c"), (2, 0, "z")]


def test_no_pages_status_and_full_text(spark):
    docs = spark.createDataFrame([(1, PAGE_SUFFIX * 2), (2, "  "), (3, "x" + PAGE_SUFFIX)], "doc_id long, text string")
    assert [r.doc_id for r in no_page_documents(docs).collect()] == [1, 2]
    st = {r.doc_id: r.status for r in document_status(docs).collect()}
    assert st == {1: "no_pages", 2: "empty_extraction", 3: "ok"}
    assert {r.doc_id: r.n_pages for r in page_counts(docs).collect()} == {1: 0, 2: 0, 3: 1}
    full = {r.doc_id: r.chunk for r in full_text_units(docs).collect()}
    assert full == {3: "x" + PAGE_SUFFIX}  # what has no page is reported, not sent
    with pytest.raises(Exception):
        strict(document_status(docs), "status <> 'ok'", "document has no pages").collect()


def test_pages_from_rows_hot_key_is_dense(spark):
    from pyspark.sql import functions as F

    from versio.operators.pages import pages_from_rows

    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    # every row under one document: the index must still be dense and in order
    hot = conv.select(F.lit(7).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "text")
    rows = pages_from_rows(hot, key="conv_id", order="turn").collect()
    assert sorted(r.page_idx for r in rows) == list(range(len(rows)))
    expected = [t.strip() for _, t in sorted((r.turn, r.text) for r in hot.collect()) if t.strip()]
    assert [r.page for r in sorted(rows, key=lambda r: r.page_idx)] == expected


def test_markdown_export_equals_reassembly(spark):
    import os
    import tempfile

    from versio.operators.assemble import export_markdown, read_markdown, reassemble
    from versio.plans.catalog import _echo_translations

    tr = _echo_translations(spark, "/root/testdata/sf0.001", limit=20)
    d = tempfile.mkdtemp(prefix="versio-md-")
    export_markdown(tr, d, partitions=24)
    docs = {r.output_name: r.content for r in reassemble(tr).collect()}
    assert {r.output_name: r.content for r in read_markdown(spark, d).collect()} == docs
    assert sorted(f for _, _, files in os.walk(d) for f in files if not f.endswith(".crc")) == sorted(docs)


def test_chosen_flag_in_row_equals_long_table(spark):
    from versio.operators.extract import flag_chosen

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    c = html_candidates(pages)
    in_row = {(r.doc_id, r.method): r.chosen for r in c.collect()}
    long = {(r.doc_id, r.method): r.chosen for r in flag_chosen(c.drop("chosen")).collect()}
    assert in_row == long
    assert sum(in_row.values()) == pages.count()


def test_document_table(spark):
    import tempfile

    from versio.operators.assemble import read_documents, reassemble, write_documents
    from versio.plans.catalog import _echo_translations

    docs = reassemble(_echo_translations(spark, "/root/testdata/sf0.001", limit=2000))
    out = tempfile.mkdtemp(prefix="versio-pq-") + "/t"
    write_documents(docs, out)
    write_documents(docs, out)
    back = read_documents(spark, out).where("target_lang = 'pt'")
    assert {r.output_name: r.content for r in back.collect()} == {r.output_name: r.content for r in docs.collect()}


def test_markdown_export_hot_document(spark):
    import os
    import tempfile

    from pyspark.sql import functions as F

    from versio.operators.assemble import export_markdown, file_name, file_pieces, read_markdown, reassemble
    from versio.plans.catalog import _echo_translations

    tr = _echo_translations(spark, "/root/testdata/sf0.001", limit=50)
    first = tr.agg(F.min("doc_id")).first()[0]
    # every chunk of every document under one document id, pages kept in order
    hot = tr.select(F.lit(7).cast("bigint").alias("doc_id"),
                    ((F.col("doc_id") - first) * 1000 + F.col("page_idx")).cast("int").alias("page_idx"),
                    "chunk_idx", "target_lang", "translated")
    # the document's first chunk is (0, 0)
    assert hot.where("page_idx = 0 and chunk_idx = 0").count() == 1
    d = tempfile.mkdtemp(prefix="versio-hot-")
    export_markdown(hot, d, partitions=16)
    assert [r.content for r in read_markdown(spark, d).collect()] == [reassemble(hot).first().content]
    tasks = file_pieces(file_name(None, hot), 16).groupBy(F.spark_partition_id()).count().count()
    assert tasks > 4 and os.listdir(d) != []  # the document was written by several tasks


def test_tag_patterns_name_the_tag_exactly(spark):
    html = ('<html><body><article><p class="x">a<pre>b</pre><param name="n">c<br/>d</p>'
            '<ul><li>e</li></ul><link rel="s"></article></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    c = {r.method: r.text for r in html_candidates(df).collect()}
    assert c["article"].split("<<<")[0].strip() == "abc\nd\ne"
    assert c["markdown"].count("\n- ") == 1


def test_stored_candidates_are_chosen_without_moving_texts(spark, tmp_path, monkeypatch):
    from versio.operators import extract

    rows = [(k % 300, f"m{k % 7}", 10 + k, None if k % 11 == 0 else " " * (k % 5) + "t" * (k * 37 % 23)) for k in range(2000)]
    rows += [(7, "hot", 9, "x" * (k % 50)) for k in range(3000)] + [(None, "n", 1, "null id"), (500, "only", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, method string, priority int, text string")
    df.repartition(5).write.parquet(str(tmp_path / "c"))
    key = lambda r: (str(r.doc_id), r.text, r.status)
    want = sorted(map(key, extract.choose_best(df).collect()), key=str)
    chosen = extract.choose_best_stored(spark, str(tmp_path / "c"))
    assert sorted(map(key, chosen.collect()), key=str) == want
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(extract, "BROADCAST_WORDS", 0)
    assert sorted(map(key, extract.choose_best_stored(spark, str(tmp_path / "c")).collect()), key=str) == want
