"""Registered queries against their DuckDB twins, or against plain Python where SQL cannot say it."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op4_knn", "op5_mixing", "op6_exact_dedup", "op8_warc", "op10_chat", "op12_repair"])
def test_query_equals_sql(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["cols_match"] and r["rows"][0] == r["rows"][1] and r["hash_match"], r


def test_every_operator_is_registered():
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def table(name, sf=SF):
    return duckdb.connect().execute(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def test_op1_equals_all_pairs(spark):
    from brute import components, simhash

    docs = table("documents", SF_MORE)
    prints = {d[0]: simhash(d[1], 3) for d in docs}
    want = components(prints, 2)
    got = E.queries()["op1_simhash"](spark, SF_MORE).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_op2_finds_long_repeats_and_leaves_others_alone(spark):
    from brute import shared_words

    docs = table("documents", SF_MORE)
    got = E.queries()["op2_substring_dedup"](spark, SF_MORE).collect()
    texts = {d[0]: d[1].encode() for d in docs}
    long, any_long = shared_words(docs, 60), shared_words(docs, 35)
    flagged = {r.doc_id for r in got}
    assert set(long) <= flagged  # a repeat of 60 words is found in every document but the first
    assert flagged <= set(any_long)
    for r in got:
        span = texts[r.doc_id][r.span_start:r.span_start + r.span_bytes]
        assert r.first_doc_id < r.doc_id and span.decode() and len(span) == r.span_bytes


def test_op3_separates_held_out_labels(spark):
    """Fitted without a fifth of the labels, the chain is measured on these, long texts apart."""
    from pyspark.sql import functions as F

    from versio.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    known = {r.doc_id: r.toxic for r in labels.where(held).collect()}
    got = [(r.toxic, known[r.doc_id], r.n) for r in toxicity.toxicity(docs, labels.where(~held)).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").collect() if r.doc_id in known]
    toxic, clean = [x for x in got if x[1]], [x for x in got if not x[1]]
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(x[0] for x in toxic) / len(toxic) > 0.8 and sum(x[0] for x in clean) / len(clean) < 0.03
    long = [x for x in clean if x[2] > 10_000]
    assert not any(x[0] for x in long)
    out = E.queries()["op3_toxicity"](spark, SF_MORE)
    rows = out.collect()
    assert len(rows) == len(table("documents", SF_MORE)) and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in rows)


def test_op7_equals_the_library(spark):
    from tokenizers import Tokenizer

    from versio.llm.queries import vocabulary

    library = Tokenizer.from_file(vocabulary())
    got = {r.doc_id: r for r in E.queries()["op7_bpe"](spark, SF).collect()}
    docs = table("documents")
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        r = got[d[0]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_held_out_accuracy(spark):
    docs = {d[0]: d for d in table("documents", SF_MORE)}
    got = E.queries()["op9_langid"](spark, SF_MORE).collect()
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in held) / len(held) > 0.98


def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline as P
    from brute import components, poisson_copies, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in E.queries()["op3_toxicity"](spark, SF).where("toxic").collect()}
    left = [d for d in table("documents") if d[0] not in rejected]
    assert {r.doc_id for r in P.STAGES[0][1](spark, docs, SF).collect()} == {d[0] for d in left}
    best = {}
    for d in left:
        key = "".join(d[1].split(" ")).translate(str.maketrans("", "", "\t\n\v\f\r"))
        order = (-len(d[1]), d[0])
        if key not in best or order < best[key][0]:
            best[key] = (order, d)
    left = [d for _, d in best.values()]
    root = components({d[0]: simhash(d[1], 3) for d in left}, 2)
    left = [d for d in left if root[d[0]] == d[0]]
    want = sorted(x for d in left for x in [d[0]] * poisson_copies(left, d))
    got = P.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in got.collect()) == want


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr(
        "*", "1 AS copy", "'x' AS _id", "2 AS kept", "3 AS fingerprint", "4 AS rate", "5 AS id", "6 AS n", "7 AS _copy", "8 AS points")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() > 0


def test_stages_on_empty_tables_and_nulls(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    rows = [(None, None, None, None, None), (None, "a text without an id", "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0),
            (3, "some words here", "en", "s", 5), (3, "some words here", "en", "s", 5), (4, "Some  words here", "en", "t", 5), (5, "w " * 100_000, "en", "t", 5)]
    some = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    left = {name: stage(spark, some, SF).collect() for name, stage in P.STAGES[:4]}
    assert len(left["toxicity"]) == 8
    # null, empty and absent texts are equal; so are the two texts of three words but for white space
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left["exact dedup"]) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    near = [r.doc_id for r in left["SimHash near-dedup"]]
    assert near.count(3) == 1 and 4 not in near and near.count(None) == 2 and 1 in near and 2 not in near
    assert all(r.doc_id is None or r.doc_id <= 5 for r in left["mixing sources"])
    assert P.STAGES[4][1](spark, some, SF).count() == 8


def test_near_copies_are_decided_row_by_row(spark):
    import random

    import corpus_pipeline as P

    rng = random.Random(7)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)) for _ in range(4))
    # texts that differ in white space or case alone have one fingerprint
    rows = [(1, a), (5, a + " "), (5, b), (5, b.upper()), (5, c), (None, c + "  "), (None, d), (None, d.upper()), (None, d)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    left = [(r.doc_id, r.text.lower().strip()) for r in P.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (5, b), (5, c), (None, d)], key=str)
