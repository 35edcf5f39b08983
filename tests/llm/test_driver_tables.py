"""Tables that grow with the input are joined without passing through the driver, whatever Spark estimates."""

import corpus_pipeline
from pyspark.sql import functions as F

from versio.llm import common, components, exact_dedup, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(df):
    return "Broadcast" in plan(df)


def test_a_repeated_key_table_is_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 9 if k % 5 else None, k) for k in range(90)], "key bigint, nth bigint")
    table = spark.createDataFrame([(k, str(k)) for k in [*range(7), None]], "key bigint, name string")
    want = {how: sorted(map(str, common.join_keys(rows, table, ["key"], F.col("nth"), how).collect())) for how in ("left", "inner")}
    assert len(want["left"]) == 90 > len(want["inner"]) > 0
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    for how in want:
        out = common.join_keys(rows, table, ["key"], F.col("nth"), how)
        assert not sent(out) and sorted(map(str, out.collect())) == want[how]


def test_exact_copies_are_dropped_without_broadcasts(spark, monkeypatch):
    rows = [(k % 200 if k % 50 else None, f"text {k % 70}" + " " * (k % 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(r.text.strip() for r in exact_dedup.keep_first(df).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    kept = exact_dedup.keep_first(df)
    assert not sent(kept) and sorted(r.text.strip() for r in kept.collect()) == want == sorted({t.strip() for _, t in rows})


def test_components_and_fingerprints_are_joined_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    edges = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(50 + k, 50) for k in range(1, 9)], "a bigint, b bigint")
    assert not sent(components._large_star(edges, 28)) and not sent(components._small_star(edges, 28))
    assert {r.node: r.root for r in components.connected_components(edges).collect()} == {k: 0 for k in range(21)} | {50 + k: 50 for k in range(9)}
    fps = spark.createDataFrame([(1 << k,) for k in range(40)], "fp bigint")  # all within two bits of each other
    for dense in (4, 512):
        found = simhash.links(fps, 2, dense)
        assert not sent(found)
        assert {r.root for r in components.connected_components(found).collect()} == {1}
    docs = spark.createDataFrame([(k, f"some words here {k // 2}") for k in range(40)], "doc_id bigint, text string")
    near = simhash.simhash_components(docs)
    assert not sent(near)
    assert {r.doc_id: r.component_id for r in near.collect()}[7] <= 6


def test_near_copies_of_shared_ids_are_dropped_without_broadcasts(spark, monkeypatch):
    rows = [(k // 2, f"text of its own {k} " + "x" * (k % 7)) for k in range(40)] + [(100 + k, f"alone {k // 3}") for k in range(9)]
    rows += [(k, t) for k, t in rows[:8]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(corpus_pipeline.drop_near_copies(spark, df, "").collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert not sent(out) and sorted(out.collect()) == want and 0 < len(want) <= len({*rows})
