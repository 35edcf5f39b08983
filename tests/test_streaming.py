"""Incremental run: streamed documents give the same translations as a batch run."""

import tempfile

from versio.operators.dispatch import translate
from versio.plans.standins import EchoService
from versio.plans.translate_job import plan_chunks, with_targets
from versio.streaming.incremental import document_stream, translate_stream


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="versio-src-")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.mode("overwrite").parquet(src + "/in")
    sink = tempfile.mkdtemp(prefix="versio-sink-") + "/out"
    ck = tempfile.mkdtemp(prefix="versio-ck-")
    q = translate_stream(document_stream(spark, src + "/in", max_files_per_trigger=1), EchoService(),
                         sink_path=sink, checkpoint_location=ck, target_langs=["de"], limit=200, concurrency=2)
    q.awaitTermination()
    streamed = spark.read.parquet(sink).select("doc_id", "page_idx", "chunk_idx", "target_lang", "translated")
    batch = translate(with_targets(plan_chunks(docs, limit=200), ["de"]), EchoService(), concurrency=2)
    b = batch.select("doc_id", "page_idx", "chunk_idx", "target_lang", "translated")
    assert streamed.count() == b.count()
    assert streamed.exceptAll(b).count() == 0


def test_replayed_batch_sends_nothing_twice(spark):
    """A batch whose answers are in the sink (replay after a failure) is not sent again; its failed chunks are."""
    from versio.operators.dispatch import answer_units
    from versio.plans.standins import FlakyService

    sink = tempfile.mkdtemp(prefix="versio-sink-") + "/out/batch_id=3"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tasks = plan_chunks(docs, limit=500)
    bad = FlakyService(EchoService(), lambda text: 3 * (len(text) % 7 == 0))
    first = answer_units(tasks, bad, sink, unit_rows=100, langs=["de"], sleep=lambda s: None)
    failed = first.where("status = 'failed'").count()
    assert failed > 0 and first.count() == tasks.count()
    before = spark.read.parquet(sink).count()
    again = answer_units(tasks, EchoService(), sink, unit_rows=100, langs=["de"])
    assert spark.read.parquet(sink).count() == before + failed
    assert again.count() == tasks.count() and again.where("status <> 'ok'").count() == 0
    assert answer_units(tasks, EchoService(), sink, langs=["de"]).count() == tasks.count()
    assert spark.read.parquet(sink).count() == before + failed


def test_stream_two_languages(spark):
    src = tempfile.mkdtemp(prefix="versio-src2-")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(2).write.mode("overwrite").parquet(src + "/in")
    sink = tempfile.mkdtemp(prefix="versio-sink2-") + "/out"
    q = translate_stream(document_stream(spark, src + "/in", max_files_per_trigger=1), EchoService(),
                         sink_path=sink, checkpoint_location=tempfile.mkdtemp(prefix="versio-ck2-"),
                         target_langs=["de", "pt"], limit=500, concurrency=2)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    n_chunks = plan_chunks(docs, limit=500).count()
    assert out.count() == 2 * n_chunks
    assert out.select("doc_id", "page_idx", "chunk_idx", "target_lang").distinct().count() == 2 * n_chunks
