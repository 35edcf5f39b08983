"""Dispatch with retry, failure marker, usage, resume, send-once."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from versio.operators.dispatch import Calls, answer_units, backoff, read_answers, tasks_at_once, translate, usage_counts
from versio.plans.standins import EchoService, FlakyService
from versio.operators.usage import usage_by_document
from versio.session import materialize


def test_backoff_matches_reference_schedule():
    # multiplier 1, floor 4 s, cap 10 s: waits after calls 1, 2, 3, 4, 5
    assert [backoff(n, 1.0, 4.0, 10.0) for n in range(1, 6)] == [4.0, 4.0, 4.0, 8.0, 10.0]


def test_the_driver_waits_between_rounds(spark):
    waits = []
    svc = FlakyService(EchoService(), lambda t: 2 if t == "late" else 0)
    out = {r.doc_id: r for r in translate(_tasks(spark, ["late", "now"]), svc, sleep=waits.append).collect()}
    assert out[0].translated == "[de] late" and out[0].attempts == 3 and out[1].attempts == 1
    assert len(waits) == 2 and all(0 < w <= 4.0 for w in waits)  # the time that the round took counts


def test_only_what_failed_is_sent_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    class Logging(FlakyService):
        def attempt(self, number):
            call = super().attempt(number)

            def logged(text, lang):
                with open(log, "a") as fh:
                    fh.write(f"{number} {text}\n")
                return call(text, lang)
            return logged

    svc = Logging(EchoService(), lambda t: int(t[1:]) % 4)
    out = translate(_tasks(spark, [f"t{i}" for i in range(40)]), svc, concurrency=4, sleep=lambda s: None).collect()
    with open(log) as fh:
        calls = sorted(fh.read().split("\n")[:-1])
    assert calls == sorted(f"{n} t{i}" for i in range(40) for n in range(1, min(i % 4 + 1, 3) + 1))
    assert all((r.status == "ok") == (r.doc_id % 4 < 3) and r.attempts == min(r.doc_id % 4 + 1, 3) for r in out)


def _tasks(spark, texts):
    rows = [(i, 0, 0, "de", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, page_idx int, chunk_idx int, target_lang string, chunk string")


def test_failures_attempts_and_marker(spark):
    # failing-call script per text: "" -> 0, "a" -> 2, "bbb" -> 3 (exhausted)
    script = {"zero": 0, "two": 2, "three": 3}
    svc = FlakyService(EchoService(), lambda t: script[t])
    out = translate(_tasks(spark, ["zero", "two", "three"]), svc, concurrency=2, sleep=lambda s: None)
    rows = {r.doc_id: r for r in out.collect()}
    assert (rows[0].attempts, rows[0].status, rows[0].translated) == (1, "ok", "[de] zero")
    assert (rows[1].attempts, rows[1].status, rows[1].translated) == (3, "ok", "[de] two")
    assert (rows[2].attempts, rows[2].status, rows[2].translated) == (3, "failed", "[CHUNK FAILED]")
    assert rows[2].prompt_tokens == 0 and rows[2].completion_tokens == 0 and rows[2].error
    assert rows[0].prompt_tokens == -(-len("Translate to de:\nzero") // 4)


def test_usage_key_styles_are_normalised(spark):
    t = _tasks(spark, ["abcdefgh"])
    a = translate(t, EchoService("prompt_completion"), concurrency=1).first()
    b = translate(t, EchoService("input_output"), concurrency=1).first()
    c = translate(t, EchoService("none"), concurrency=1).first()
    assert (a.prompt_tokens, a.completion_tokens) == (b.prompt_tokens, b.completion_tokens) != (0, 0)
    assert (c.prompt_tokens, c.completion_tokens, c.usage_reported) == (0, 0, False)


def test_none_text_is_a_failure(spark):
    out = translate(_tasks(spark, ["x"]), lambda text, lang: (None, {}), concurrency=1,
                    sleep=lambda s: None).first()
    assert out.status == "failed" and out.translated == "[CHUNK FAILED]"


def test_resume_skips_answered_chunks(spark):
    t = _tasks(spark, ["a", "b", "c"])
    done = translate(t.where("doc_id = 1"), EchoService(), concurrency=1)
    rest = translate(t, EchoService(), concurrency=2, resume_from=done)
    assert sorted(r.doc_id for r in rest.collect()) == [0, 2]


def test_each_chunk_is_sent_once_with_two_consumers(spark):
    class CountingService:
        """Appends one line per call to a file (calls happen in Python workers)."""

        def __init__(self, path):
            self.path = path

        def __call__(self, text, lang):
            with open(self.path, "a") as fh:
                fh.write("x\n")
            return EchoService()(text, lang)

    path = os.path.join(tempfile.mkdtemp(prefix="versio-calls-"), "calls")
    t = _tasks(spark, [f"text {i}" for i in range(40)])
    tr = materialize(translate(t, CountingService(path), concurrency=4))
    usage_by_document(tr).count()
    tr.groupBy("doc_id").agg(F.max("translated")).count()
    with open(path) as fh:
        assert len(fh.readlines()) == 40


def test_threads_per_task_give_same_answers(spark):
    t = _tasks(spark, [f"text {i}" for i in range(50)])
    a = sorted(map(tuple, translate(t, EchoService(), concurrency=2).collect()))
    b = sorted(map(tuple, translate(t, EchoService(), concurrency=2, in_flight_per_task=4).collect()))
    assert a == b


def test_job_end_to_end_and_strict(spark):
    from versio.plans.translate_job import translate_documents

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    run = translate_documents(docs, EchoService(), target_langs=["pt", "de"], limit=500, concurrency=4,
                              model="deepseek-chat")
    d = run.documents.collect()
    assert len(d) == 2 * docs.count()
    assert all(r.content.startswith(f"[{r.target_lang}] ") for r in d)
    u = run.usage.collect()
    assert all(r.cost_status == "ok" and r.cost_usd > 0 for r in u)
    flaky = FlakyService(EchoService(), lambda text: 3)
    with pytest.raises(Exception):
        translate_documents(docs, flaky, target_langs=["pt"], limit=500, strict=True, sleep=lambda s: None)


def test_identity_translation_reassembles_pages(spark):
    from versio.functions.text import PAGE_SUFFIX
    from versio.operators.assemble import reassemble
    from versio.plans.translate_job import plan_chunks, with_targets

    def identity(text, lang):
        return text, {}

    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    pages = {}
    for r in conv.collect():
        pages.setdefault(r.conv_id, []).append((r.turn, r.text.strip()))
    docs = spark.createDataFrame(
        [(k, "".join(t + PAGE_SUFFIX for _, t in sorted(v))) for k, v in pages.items()], "doc_id long, text string")
    tr = translate(with_targets(plan_chunks(docs, limit=10 ** 9), ["xx"]), identity, concurrency=3)
    got = {r.doc_id: r.content for r in reassemble(tr).collect()}
    assert got == {k: "\n\n".join(t for _, t in sorted(v) if t) for k, v in pages.items()}
    tot = usage_by_document(tr).collect()
    assert all(r.total_tokens_total == r.prompt_tokens_total + r.completion_tokens_total for r in tot)


def test_page_rows_job_equals_marked_text_job(spark):
    from versio.functions.text import PAGE_SUFFIX
    from versio.plans.translate_job import translate_documents, translate_page_rows

    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "text")
    a = translate_page_rows(conv, EchoService(), key="conv_id", order="turn", target_langs=["fr"], limit=300)
    marked = {}
    for r in conv.collect():
        marked.setdefault(r.conv_id, []).append((r.turn, r.text))
    docs = spark.createDataFrame([(k, "".join(t.strip() + PAGE_SUFFIX for _, t in sorted(v))) for k, v in marked.items()],
                                 "doc_id long, text string")
    b = translate_documents(docs, EchoService(), target_langs=["fr"], limit=300)
    assert sorted(map(tuple, a.documents.collect())) == sorted(map(tuple, b.documents.collect()))


def test_job_reports_documents_without_pages(spark):
    from versio.functions.text import PAGE_SUFFIX
    from versio.plans.translate_job import translate_documents, translate_page_rows

    docs = spark.createDataFrame([(1, "hello"), (2, PAGE_SUFFIX * 3), (3, "  ")], "doc_id long, text string")
    run = translate_documents(docs, EchoService(), target_langs=["pt"], limit=100)
    assert {r.doc_id for r in run.documents.collect()} == {1}
    assert {r.doc_id: r.status for r in run.status.collect()} == {1: "ok", 2: "no_pages", 3: "empty_extraction"}
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (2, 0, "  ")], "doc_id long, page_no long, text string")
    run2 = translate_page_rows(rows, EchoService(), target_langs=["pt"], limit=100)
    assert {r.doc_id: (r.n_pages, r.status) for r in run2.status.collect()} == {1: (1, "ok"), 2: (0, "no_pages")}


def test_language_expansion_inside_dispatch(spark):
    from versio.plans.translate_job import with_targets

    t = _tasks(spark, [f"text {i}" for i in range(20)]).drop("target_lang")
    langs = ["pt", "de", "fr"]
    inside = sorted(map(tuple, translate(t, EchoService(), concurrency=3, langs=langs).collect()))
    exploded = sorted(map(tuple, translate(with_targets(t, langs), EchoService(), concurrency=3).collect()))
    assert inside == exploded and len(inside) == 60
    done = translate(with_targets(t.where("doc_id < 5"), ["de"]), EchoService(), concurrency=2)
    rest = translate(t, EchoService(), concurrency=2, langs=langs, resume_from=done)
    assert rest.count() == 60 - 5


def test_usage_never_costs_a_second_call(spark):
    from decimal import Decimal

    calls = []

    def service(text, lang):
        calls.append(text)
        return "answer", {"prompt_tokens": Decimal("7"), "completion_tokens": object()}

    [got] = Calls(1, None).answers(service, [("x", "de")])
    assert got[0] == "answer" and got[2] is None and calls == ["x"]
    assert usage_counts(got[1]) == (7, 0, True)
    assert usage_counts(None) == usage_counts({}) == usage_counts("many") == (0, 0, False)
    assert usage_counts({"input_tokens": 3, "output_tokens": None}) == (3, 0, True)


def test_a_call_that_hangs_is_given_up_and_counts_until_it_ends():
    import threading
    import time

    open_now, most, lock = 0, 0, threading.Lock()

    def service(text, lang):
        nonlocal open_now, most
        with lock:
            open_now += 1
            most = max(most, open_now)
        time.sleep(0.15 if text == "slow" else 0.01)
        with lock:
            open_now -= 1
        return text, {}

    for in_flight in (1, 3):
        most = 0
        texts = ["a", "slow", "b", "slow", "c", "d", "e"]
        calls = Calls(in_flight, 0.1)
        got = [g for part in (texts[:4], texts[4:]) for g in calls.answers(service, [(t, "de") for t in part])]
        calls.close()
        assert [g[0] for g in got] == [None if t == "slow" else t for t in texts]
        assert all("TimeoutError" in g[2] for g, t in zip(got, texts) if t == "slow")
        assert most <= in_flight and open_now == 0  # the last one was waited for


def test_failed_chunks_are_sent_again_on_resume(spark):
    t = _tasks(spark, ["a", "b", "c"])
    bad = FlakyService(EchoService(), lambda text: 3 if text == "b" else 0)
    first = materialize(translate(t, bad, concurrency=2, sleep=lambda s: None))
    assert [r.doc_id for r in first.where("status = 'failed'").collect()] == [1]
    second = translate(t, EchoService(), concurrency=2, resume_from=first).collect()
    assert [(r.doc_id, r.status) for r in second] == [(1, "ok")]


def test_open_requests_are_capped_whatever_the_number_of_tasks(spark):
    class Watching:
        """Counts the calls that are open at the same time with one file each."""

        def __init__(self, folder):
            self.folder = folder

        def __call__(self, text, lang):
            import time
            import uuid

            name = os.path.join(self.folder, uuid.uuid4().hex)
            open(name, "w").close()
            n = len(os.listdir(self.folder))
            time.sleep(0.01)
            os.remove(name)
            return str(n), {}

    folder = tempfile.mkdtemp(prefix="versio-open-")
    for in_flight in (1, 2, 3, 5):
        out = translate(_tasks(spark, [f"t{i}" for i in range(60)]), Watching(folder), concurrency=3, in_flight_per_task=in_flight, partitions=8)
        assert max(int(r.translated) for r in out.collect()) <= 3
    assert (tasks_at_once(7, 2), tasks_at_once(4, 4), tasks_at_once(2, 3)) == (3, 1, 1)


def test_task_slots_keep_the_cap(spark):
    from versio.operators.dispatch import slots_profile

    for concurrency, in_flight, executors, cores in ((64, 4, 4, 8), (10, 1, 3, 16), (1000, 8, 100, 4), (6, 6, 1, 4), (7, 9, 1, 5)):
        cpus = slots_profile(concurrency, in_flight, executors, cores).taskResources["cpus"].amount
        open_ = lambda c: executors * (cores // int(c)) * min(in_flight, concurrency)  # noqa: E731, B023
        assert open_(cpus) <= concurrency and (cpus == 1 or open_(cpus - 1) > concurrency)
    assert slots_profile(4, 1, 1000, 8) is None


def test_a_worker_that_dies_costs_one_unit(spark):
    """A run whose worker dies late keeps the units before; the next run sends the rest."""
    class Dying:
        def __init__(self, log, fatal):
            self.log, self.fatal = log, fatal

        def __call__(self, text, lang):
            with open(self.log, "a") as fh:
                fh.write(text + "\n")
            if self.fatal and text == "text 77":
                raise SystemExit("the worker dies")
            return EchoService()(text, lang)

    folder = tempfile.mkdtemp(prefix="versio-dying-")
    log, sink = os.path.join(folder, "calls"), os.path.join(folder, "sink")
    t = _tasks(spark, [f"text {i}" for i in range(200)]).drop("target_lang")
    failed = False
    try:
        answer_units(t, Dying(log, True), sink, unit_rows=20, langs=["de"], partitions=2)
    except Exception:
        failed = True
    with open(log) as fh:
        first = len(fh.readlines())
    done = read_answers(spark, sink)
    n_done = 0 if done is None else done.count()
    out = answer_units(t, Dying(log, False), sink, unit_rows=20, langs=["de"], partitions=2)
    with open(log) as fh:
        calls = len(fh.readlines())
    assert out.count() == 200 and out.where("status <> 'ok'").count() == 0
    if failed:  # what was not committed is at most a unit; Spark may have tried it more than once
        assert calls - first == 200 - n_done
    else:
        assert calls in (200, 201, 202)  # the error was retried as a failed call


def test_unposted_and_malformed_requests(spark):
    from versio.operators.dispatch import send_requests
    from versio.operators.response import parse_responses

    rows = [(1, 0, 0, "de", "openai", "{}"), (2, 0, 0, "de", "nope", None), (3, 0, 0, "de", "openai", "bad")]
    reqs = spark.createDataFrame(rows, "doc_id long, page_idx int, chunk_idx int, target_lang string, provider string, body string")

    def post(provider, body):
        return '{"oops": 1}' if body == "bad" else '{"choices": [{"message": {"content": "x"}}]}'

    got = {r.doc_id: r for r in parse_responses(send_requests(reqs, post, sleep=lambda s: None)).collect()}
    assert (got[1].status, got[1].attempts, got[1].usage_reported) == ("ok", 1, False)
    assert (got[2].status, got[2].attempts, got[2].error) == ("failed", 0, "not sent")
    assert (got[3].status, got[3].attempts) == ("failed", 3) and "KeyError" in got[3].error


def test_a_reply_is_parsed_once(spark):
    from versio.operators.response import parse_responses

    raw = spark.createDataFrame([("choices", "{}")], "reply_style string, body string")
    plan = parse_responses(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    df = translate(_tasks(spark, ["x"]), EchoService(), concurrency=1)
    assert "from_json" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_one_piece_of_a_batch(spark):
    """Answers come back piece by piece: the first rows of a long batch are returned before its last ones are asked."""
    import pyarrow as pa

    from versio.functions.batches import PIECE_BYTES, PIECE_ROWS, pieces

    long = pa.record_batch({"id": list(range(40)), "text": ["x" * 1_000_000] * 40})
    short = pa.record_batch({"id": list(range(9_999))})
    for batch, least in ((long, 1), (short, 1), (long, 16), (short, 6_000), (short.slice(5, 1), 1), (short.slice(0, 0), 1)):
        cut = list(pieces(batch, least))
        assert [x for p in cut for x in p.column("id").to_pylist()] == batch.column("id").to_pylist()
        assert all(least <= p.num_rows or p.num_rows == batch.num_rows for p in cut)
        assert all(p.num_rows < 2 * least or (p.num_rows <= PIECE_ROWS and p.nbytes <= PIECE_BYTES) for p in cut)

    class Held:
        """Answers with the number of rows that its thread was given."""

        def __call__(self, text, lang):
            import sys

            at = sys._getframe()
            while "rows" not in at.f_locals or not isinstance(at.f_locals["rows"], list):
                at = at.f_back
            return str(len(at.f_locals["rows"])), {}

    tasks = spark.range(5_000, numPartitions=1).selectExpr("id AS doc_id", "0 AS page_idx", "0 AS chunk_idx", "'t' AS chunk")
    got = translate(tasks, Held(), concurrency=1, langs=["de", "pt"]).selectExpr("int(translated) AS n", "target_lang").collect()
    assert len(got) == 10_000 and {r.target_lang for r in got} == {"de", "pt"} and max(r.n for r in got) <= PIECE_ROWS
