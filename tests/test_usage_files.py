"""F1, G2-G6, H10, H13 (cost, report) and A1-A4, A6, H8 (files)."""

import os
import tempfile

from versio.operators.usage import estimate_cost, usage_report
from versio.sources.files import (conversion_route, file_stem, file_suffix, missing_files, parse_formats,
                                  list_files, scan_files)

COSTS = [  # FIXTURES.md section 8
    ("deepseek-chat", "miss", 1234567, 7654321, 8.59259248, "$8.5926"),
    ("deepseek-chat", "hit", 1000000, 0, 0.07, "$0.0700"),
    ("deepseek-reasoner", "miss", 1000000, 1000000, 2.74, "$2.7400"),
    ("unknown", "miss", 1, 1, None, None),
    ("deepseek-chat", "other", 1, 1, None, None),
]


def test_cost_and_report(spark):
    rows = [(i, "pt", m, c, p, q, p + q) for i, (m, c, p, q, _, _) in enumerate(COSTS)]
    u = spark.createDataFrame(rows, "doc_id long, target_lang string, model string, cache string, "
                                    "prompt_tokens_total long, completion_tokens_total long, total_tokens_total long")
    got = {r.doc_id: r for r in usage_report(estimate_cost(u)).collect()}
    for i, (_, _, _, _, cost, text) in enumerate(COSTS):
        if cost is None:
            assert got[i].cost_status == "no_price" and got[i].cost_text is None
        else:
            assert abs(got[i].cost_usd - cost) < 1e-9 and got[i].cost_text == text


NAMES = [("/a/b.PDF", ".pdf", True, "passthrough"), ("/a/b.docx", ".docx", True, "convert"),
         ("/a/b.odt", ".odt", True, "convert"), ("/a/b.tar.gz", ".gz", False, "rejected"),
         ("/a/.pdf", "", False, "rejected"), ("/a/b", "", False, "rejected"), ("/a.d/b", "", False, "rejected")]


def test_names_suffix_and_route(spark):
    from pathlib import PurePosixPath

    df = spark.createDataFrame([(n,) for n, *_ in NAMES], "path string")
    got = {r.path: r for r in conversion_route(df).collect()}
    for name, suffix, ok, route in NAMES:
        r = got[name]
        assert (r.suffix, r.format_ok, r.route) == (suffix, ok, route)
        assert r.stem == PurePosixPath(name).stem
    assert got["/a/b.docx"].pdf_name == "b.pdf"


def test_formats_are_trimmed():
    assert parse_formats(" .PDF, .txt ,") == [".pdf", ".txt"]


def test_scan_and_missing(spark):
    d = tempfile.mkdtemp(prefix="versio-files-")
    for name, data in (("a.pdf", b"%PDF"), ("b.docx", b"PK"), ("c.txt", b"t")):
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    files = scan_files(spark, d)
    rows = {os.path.basename(r.path): r for r in files.collect()}
    assert set(rows) == {"a.pdf", "b.docx"} and all(r.format_ok and r.doc_id == r.path for r in rows.values())
    assert {os.path.basename(r.path): r.format_ok for r in list_files(spark, d).collect()} == {"a.pdf": True, "b.docx": True, "c.txt": False}
    assert [os.path.basename(r.path) for r in scan_files(spark, d, formats=" .TXT ,.md").collect()] == ["c.txt"]
    assert bytes(rows["a.pdf"].content) == b"%PDF"
    manifest = spark.createDataFrame([("a.pdf",), ("z.pdf",)], "name string")
    present = list_files(spark, d).select(file_stem("path").alias("s"), file_suffix("path").alias("x")).selectExpr("concat(s, x) AS name")
    assert [r.name for r in missing_files(manifest, present).collect()] == ["z.pdf"]


def test_money_rounds_like_python(spark):
    from versio.operators.usage import with_money

    vals = [0.03125, 0.00015, 1.23115, 2.96615, 3.02845, 1.12005, 0.0, 5e-05, 4.9999e-05, 8.59259248, 1e7 + 0.00005,
            123.45675, -0.03125, 2.0 ** 53, 2.0 ** 52 - 0.5, 2.0 ** 51 + 0.25, 1e15 + 0.125, 2.0 ** -30]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.s for r in with_money(df, "v", "s").collect()]
    assert got == [f"${v:.4f}" for v in vals]


def test_extract_files_front_half(spark):
    from versio.operators.extract import PyExtractor
    from versio.plans.translate_job import extract_files, translate_documents
    from versio.plans.standins import EchoService

    d = tempfile.mkdtemp(prefix="versio-docs-")
    for name, data in (("a.pdf", "page one\fpage two"), ("b.docx", "   "), ("c.txt", "not allowed")):
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(data)
    ex = [PyExtractor("native", 1, lambda b: b.decode().split("\f")),
          PyExtractor("markdown", 3, lambda b: [b.decode()], paged=False)]
    res = extract_files(spark, d, ex)
    routes = {os.path.basename(r.path): r.route for r in res.files.collect()}
    assert routes == {"a.pdf": "passthrough", "b.docx": "convert", "c.txt": "rejected"}
    assert [os.path.basename(r.path) for r in res.rejected.collect()] == ["c.txt"]
    got = {r.doc_id: r for r in res.extracted.collect()}
    # The blank file's paged text is only markers, which is not blank, so
    # the extraction is "ok" and the document is reported as having no pages
    assert sorted(r.status for r in got.values()) == ["ok", "ok"]
    full = [r for r in got.values() if "page one" in r.text][0]
    assert full.method == "native" and full.text.count("<<<PAGE_BREAK>>>") == 2
    run = translate_documents(res.extracted, EchoService(), target_langs=["pt"], limit=100)
    assert [r.content for r in run.documents.collect()] == ["[pt] page one\n\n[pt] page two"]
    assert sorted(r.status for r in run.status.collect()) == ["no_pages", "ok"]
