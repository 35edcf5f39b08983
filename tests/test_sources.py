"""Scans and fixed dimensions."""

from versio.sources import dimensions as dims
from versio.sources.tables import read_table


def test_read_table_prunes_columns_and_adds_no_exchange(spark):
    df = read_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lang" not in plan.split("ReadSchema")[1]


def test_dimensions_are_small_local_relations(spark):
    assert dims.pricing(spark).count() == 4
    assert dims.default_models(spark).count() == 5
    assert dims.known_models(spark).count() == 27
    plan = dims.pricing(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan


def test_checkpoint_dir_comes_from_the_session(spark):
    from versio.session import ensure_checkpoint_dir, materialize

    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    d = ensure_checkpoint_dir(spark)
    assert d
    if conf:
        assert conf.split(":", 1)[-1].rstrip("/") in d
    assert materialize(spark.range(10)).count() == 10
