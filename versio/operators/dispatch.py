"""Dispatch of translation requests.

A service is any picklable callable ``(text, target_lang) -> (text, usage)``
where ``usage`` is a dict in one of the providers' key styles (or ``{}``). A
service with a method ``attempt(n)`` is asked for the callable of each row's
attempt. Requests are sent in rounds, a Spark job each:

* cap: a round has ``concurrency // in_flight_per_task`` tasks, each with at most
  ``in_flight_per_task`` requests open, so at most ``concurrency`` are open in the
  whole cluster however many machines it has. With a ``ResourceProfile`` (stage-level
  scheduling, where the cluster has it) Spark's task slots are the cap instead and the
  number of tasks may follow the data. A call that was given up after ``timeout``
  seconds keeps its place until it ends;
* retry: up to ``max_attempts`` calls per chunk. A round does not wait: a row that
  failed comes back with the time when it is due, after
  ``clamp(multiplier * 2**(attempt-1), wait_min, wait_max)`` seconds, and goes with
  the first round from then on, together with rows that are new. Only the driver
  waits, when nothing else is left to send. Reading the reply's text belongs to the
  call and is retried, its usage is read afterwards: an answer that was paid for is
  never sent again because of its usage. An exhausted chunk gets the failure marker,
  zero usage and the last error, and the rest of the document goes on;
* each round is a written table, so later consumers never send anything again;
* keys travel with each row, so completion order does not matter;
* ``resume_from`` leaves out chunks that were answered (status ``ok``); failed
  ones are sent again.

``answer_units`` commits answers in small units, so that a run that dies loses
at most the calls of one unit; retries of a unit go with the units after it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from versio.functions.batches import PIECE_BYTES, PIECE_ROWS, pieces
from versio.functions.text import FAILED_MARKER
from versio.session import ensure_checkpoint_dir
from versio.sources.dimensions import (
    DEFAULT_CONCURRENCY,
    MAX_ATTEMPTS,
    REQUEST_TIMEOUT_S,
    WAIT_MAX_S,
    WAIT_MIN_S,
    WAIT_MULTIPLIER,
)

Service = Callable[[str, str], tuple]

DEFAULT_KEYS = ("doc_id", "page_idx", "chunk_idx")


def backoff(attempt: int, multiplier: float, wait_min: float, wait_max: float) -> float:
    """Wait after failed call number ``attempt`` (1-based)."""
    return min(max(multiplier * 2 ** (attempt - 1), wait_min), wait_max)


class Calls:
    """Calls of one task: at most ``in_flight`` are open at a time. One that takes longer than ``timeout`` seconds is
    given up; it counts as open until it ends."""

    def __init__(self, in_flight: int, timeout: float | None) -> None:
        self.in_flight, self.timeout = in_flight, timeout
        self.lock, self.threads = threading.Lock(), []

    def answers(self, call: Callable, rows: Iterable[tuple]) -> list[tuple]:
        """(answer | None, usage, error | None) of ``call(*row)`` for each row, in order. Threads take the rows one by
        one; this one only looks after the time."""
        rows, lock = list(rows), self.lock
        out: list = [None] * len(rows)
        running: dict[int, tuple[int, float]] = {}
        left, fatal, todo, over = len(rows), [], iter(range(len(rows))), threading.Event()

        def settle(i: int, result: tuple) -> None:
            nonlocal left
            if out[i] is None:
                out[i], left = result, left - 1
                if not left:
                    over.set()

        def work(me: int) -> None:
            while True:
                with lock:
                    i = next(todo, None)
                    if i is None or fatal:
                        return
                    running[me] = i, time.monotonic()
                try:
                    answer, usage = call(*rows[i])
                    if answer is None:
                        raise ValueError("reply has no text")
                    result = answer, usage, None
                except Exception as exc:  # every error is retried, as in the reference
                    result = None, None, f"{type(exc).__name__}: {exc}"
                except BaseException as exc:  # the worker is to end
                    fatal.append(exc)
                    over.set()
                    return
                with lock:
                    del running[me]
                    settle(i, result)

        def late(now: float) -> float | None:
            """Give up what has taken too long; seconds until something may again."""
            with lock:
                for i, begun in running.values():
                    if begun + self.timeout <= now:
                        settle(i, (None, None, f"TimeoutError: no reply within {self.timeout:g} s"))
                return min((begun + self.timeout - now for i, begun in running.values() if out[i] is None), default=self.timeout)

        self.threads = [t for t in self.threads if t.is_alive()]  # given up earlier and still open
        while len(self.threads) >= self.in_flight:
            self.threads[0].join(self.timeout)
            self.threads = [t for t in self.threads if t.is_alive()]
        own = [threading.Thread(target=work, args=(me,), daemon=True) for me in range(min(self.in_flight - len(self.threads), len(rows)))]
        for t in own:
            t.start()
        wait = self.timeout or None
        while left and not over.wait(wait):
            wait = late(time.monotonic())
        if fatal:
            raise fatal[0]
        for me, t in enumerate(own):
            if me in running:
                self.threads.append(t)
            else:
                t.join()
        return out

    def close(self) -> None:
        """Wait for calls that were given up, ``timeout`` seconds at most."""
        end = time.monotonic() + (self.timeout or 0)
        for t in self.threads:
            t.join(max(0.0, end - time.monotonic()) if self.timeout else None)


def usage_counts(usage: object) -> tuple[int, int, bool]:
    """(prompt tokens, completion tokens, reported) of either key style; a value
    that is no number counts as absent."""
    def whole(*keys: str) -> int | None:
        for k in keys:
            try:
                return int(usage[k])
            except (KeyError, TypeError, ValueError, OverflowError):
                continue
        return None

    if not isinstance(usage, Mapping):
        return 0, 0, False
    p, c = whole("prompt_tokens", "input_tokens"), whole("completion_tokens", "output_tokens")
    return p or 0, c or 0, p is not None or c is not None


def tasks_at_once(concurrency: int, in_flight_per_task: int) -> int:
    """Tasks of a round: with so many, at most ``concurrency`` requests are open."""
    return max(1, concurrency // in_flight_per_task)


def slots_profile(concurrency: int, in_flight_per_task: int, executors: int, cores: int) -> ResourceProfile | None:
    """A profile (for the option ``profile``) whose tasks take so many CPUs that Spark runs at most ``concurrency``
    requests at a time on ``executors`` executors of ``cores`` cores: stage-level scheduling, on clusters that have
    it. None if one task on each executor would already be too much; then the number of tasks is the cap."""
    tasks = concurrency // (min(in_flight_per_task, concurrency) * executors)
    if not tasks:
        return None
    cpus = next(c for c in range(1, cores + 1) if cores // c <= tasks)
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build


def _send(todo: DataFrame, call: Callable[[str, str], tuple], args: tuple[str, str], carry: Sequence[str], *, langs: Sequence[str] | None,
          max_attempts: int, wait: tuple[float, float, float], timeout: float | None, in_flight_per_task: int, partitions: int,
          profile: ResourceProfile | None, deal: bool) -> DataFrame:
    """One call for every row of ``todo`` (carry, args, attempt) -> carry + answer, attempts, error, prompt_tokens,
    completion_tokens, usage_reported, due, held.

    ``due`` is the time (seconds) from which a failed row may be sent again and ``held`` what is sent then; both
    are null for answers and for rows out of attempts. A row whose ``args[1]`` is null is sent once for each of
    ``langs``, so the exchange moves every text once however many languages there are. A task holds the texts and
    answers of one piece of an Arrow batch at a time."""
    types = {f.name: f.dataType.simpleString() for f in todo.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in carry) + (
        ", answer string, attempts int, error string, prompt_tokens bigint, completion_tokens bigint, "
        "usage_reported boolean, due double, held string")
    carry, langs = list(carry), list(langs or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = getattr(call, "attempt", None)

        def one(attempt: int, text: str, other: str) -> tuple:
            return (at(attempt) if at else call)(text, other)

        calls, each_row = Calls(in_flight_per_task, timeout), max(1, len(langs))
        for whole in batches:
            # a piece has no fewer rows than calls may be open
            for batch in pieces(whole, -(-in_flight_per_task // each_row), PIECE_ROWS // each_row or 1, PIECE_BYTES // each_row):
                numbers, texts, others = (batch.column(c).to_pylist() for c in ("attempt", *args))
                # a row without the second argument is sent once for each language
                each = [langs if langs and x is None else [x] for x in others]
                which, others = [k for k, xs in enumerate(each) for _ in xs], [x for xs in each for x in xs]
                numbers, texts = [numbers[k] for k in which], [texts[k] for k in which]
                got = calls.answers(one, zip(numbers, texts, others, strict=True))
                now = time.time()
                again = [e is not None and n < max_attempts for (_, _, e), n in zip(got, numbers, strict=True)]
                counts = [usage_counts(u) for _, u, _ in got]
                rows = pa.array(which, pa.int32())
                kept = [pa.array(others, batch.schema.field(c).type) if c == args[1] else batch.column(c).take(rows) for c in carry]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([a for a, _, _ in got], pa.string()), pa.array(numbers, pa.int32()), pa.array([e for _, _, e in got], pa.string()),
                     pa.array([p for p, _, _ in counts], pa.int64()), pa.array([c for _, c, _ in counts], pa.int64()),
                     pa.array([r for _, _, r in counts], pa.bool_()),
                     pa.array([now + backoff(n, *wait) if x else None for x, n in zip(again, numbers, strict=True)], pa.float64()),
                     pa.array([t if x else None for x, t in zip(again, texts, strict=True)], pa.string())],
                    [*carry, "answer", "attempts", "error", "prompt_tokens", "completion_tokens", "usage_reported", "due", "held"])
        calls.close()

    # rows of retries alone lie as they were dealt in the round before
    dealt = todo.repartition(partitions) if deal else todo.coalesce(partitions)
    return dealt.mapInArrow(run, schema, profile=profile)


def _rounds(units: Iterable[DataFrame], call: Callable[[str, str], tuple], args: tuple[str, str], carry: Sequence[str], folder: Callable[[int], str], *,
            langs: Sequence[str] | None = None, concurrency: int = DEFAULT_CONCURRENCY, in_flight_per_task: int = 1, partitions: int | None = None,
            profile: ResourceProfile | None = None, max_attempts: int = MAX_ATTEMPTS, wait_multiplier: float = WAIT_MULTIPLIER,
            wait_min: float = WAIT_MIN_S, wait_max: float = WAIT_MAX_S, timeout: float | None = REQUEST_TIMEOUT_S,
            sleep: Callable[[float], None] = time.sleep, finish: Callable[[DataFrame], DataFrame] = lambda table: table) -> DataFrame | None:
    """Send ``units`` (carry and args) and what failed of them, round by round; round k is the Parquet table
    ``folder(k)``. Returns the tables as one, without the rows that were sent again; None if there was no unit."""
    in_flight_per_task = min(in_flight_per_task, concurrency)
    at_once = tasks_at_once(concurrency, in_flight_per_task)
    n = partitions or at_once if profile is not None else min(partitions or at_once, at_once)
    fresh, waiting, paths = iter(units), [], []  # waiting: (time from which all its rows may be sent, rows)
    columns = list(dict.fromkeys([*carry, *args]))
    skipped = 0.0  # what an injected sleep did not wait
    while True:
        unit = next(fresh, None)
        now = time.time() + skipped
        if unit is None:
            if not waiting:
                return spark.read.schema(raw.schema).parquet(*paths).where("due is null") if paths else None
            first = min(due for due, _ in waiting)
            if first > now:
                sleep(first - now)
                skipped = max(skipped, first - time.time())
                now = first
        batch = [rows for due, rows in waiting if due <= now]
        waiting = [x for x in waiting if x[0] > now]
        if unit is not None:
            batch.insert(0, unit.withColumn("attempt", F.lit(1)).select(*columns, "attempt"))
        todo = reduce(DataFrame.unionByName, batch)
        spark = todo.sparkSession
        raw = _send(todo, call, args, carry, langs=langs, max_attempts=max_attempts, wait=(wait_multiplier, wait_min, wait_max), timeout=timeout,
                    in_flight_per_task=in_flight_per_task, partitions=n, profile=profile, deal=unit is not None)
        paths.append(folder(len(paths)))
        raw, seen = finish(raw), Observation()
        raw.observe(seen, F.max("due").alias("due")).write.parquet(paths[-1])
        due = seen.get["due"]
        if due is not None:
            table = spark.read.schema(raw.schema).parquet(paths[-1]).where("due is not null")
            again = table.withColumnRenamed("held", args[0]) if args[0] not in carry else table
            waiting.append((due, again.withColumn("attempt", F.col("attempts") + 1).select(*columns, "attempt")))


def unanswered(tasks: DataFrame, answers: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Tasks without an answer of status ``ok``."""
    if answers is None:
        return tasks
    return tasks.join(answers.where(F.col("status") == "ok").select(*keys), list(keys), "left_anti")


def translate(
    tasks: DataFrame,
    service: Service,
    *,
    text_col: str = "chunk",
    lang_col: str = "target_lang",
    keys: Sequence[str] = DEFAULT_KEYS,
    resume_from: DataFrame | None = None,
    keep_text: bool = False,
    langs: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """tasks(keys, target_lang, chunk) -> translations(keys, target_lang, translated,
    status, attempts, error, prompt_tokens, completion_tokens, usage_reported).

    The requests are sent by this call, and the result is read from the written tables of the
    rounds. ``langs`` sends every task once per listed language (tasks then need no language
    column): the chunk text crosses the exchange once, not once per language. With
    ``resume_from`` the languages are expanded before the anti join. ``keep_text`` also carries
    the source text through, so checks that read source and answer together need no join back
    to the chunks. Options are those of the rounds: ``concurrency``, ``in_flight_per_task``,
    ``partitions``, ``profile``, ``max_attempts``, ``wait_multiplier``, ``wait_min``,
    ``wait_max``, ``timeout``, ``sleep``."""
    keys = list(keys)
    if langs is not None and resume_from is not None:
        tasks = tasks.withColumn(lang_col, F.explode(F.array(*[F.lit(x) for x in langs])))
        langs = None
    if langs is not None:
        todo = tasks.select(*keys, F.lit(None).cast("string").alias(lang_col), text_col)
    else:
        todo = unanswered(tasks.select(*keys, lang_col, text_col), resume_from, [*keys, lang_col])

    base = _scratch(tasks.sparkSession, "answers")
    carry = [*keys, lang_col] + ([text_col] if keep_text else [])
    raw = _rounds([todo], service, (text_col, lang_col), carry, lambda k: f"{base}/{k}", langs=langs, **options)
    return normalise(raw.withColumnRenamed("answer", "translated"), keys=carry)


def _scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def normalise(raw: DataFrame, *, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Failure marker and zero usage on failure."""
    ok = F.col("translated").isNotNull()
    zero = F.lit(0).cast("bigint")
    return raw.select(
        *keys,
        F.when(ok, F.col("translated")).otherwise(F.lit(FAILED_MARKER)).alias("translated"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        "attempts",
        "error",
        F.when(ok, F.col("prompt_tokens")).otherwise(zero).alias("prompt_tokens"),
        F.when(ok, F.col("completion_tokens")).otherwise(zero).alias("completion_tokens"),
        (ok & F.col("usage_reported")).alias("usage_reported"),
        *also,
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_answers(spark: SparkSession, sink: str, keys: Sequence[str] = (*DEFAULT_KEYS, "target_lang")) -> DataFrame | None:
    """The answers in a sink of ``answer_units``, one row per key: an ``ok`` row if there is one,
    else the latest attempt. None if nothing was written yet."""
    if not _exists(spark, sink):
        return None
    rows = spark.read.option("basePath", sink).parquet(sink).drop("due", "held")
    latest = F.struct(F.col("status") == "ok", F.col("run").cast("string"), "attempts")
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), latest)
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").drop("run", "unit", "batch_id")


#: Folders of pending requests that a task writes.
SHARES_PER_FILE = 8


def answer_units(tasks: DataFrame, service: Service, sink: str, *, unit_rows: int = 100_000, langs: Sequence[str] | None = None,
                 keys: Sequence[str] = DEFAULT_KEYS, lang_col: str = "target_lang", text_col: str = "chunk", **options) -> DataFrame | None:
    """Answer ``tasks`` into the Parquet folder ``sink`` in units of about ``unit_rows`` requests, each
    committed as a folder of its own before the next is sent, and return ``read_answers``.

    What ``sink`` holds with status ``ok`` is not sent again, whichever run wrote it; failed chunks are. A row
    that is to be tried again stands in the sink as failed, until a later unit has its next attempt.
    Pending requests are written to the shared checkpoint folder once, ordered by a hash of their keys; a
    unit is a range of it, and the folders it lies in are named by their range, so planning one skips the files of
    the others.
    """
    spark, keys = tasks.sparkSession, list(keys)
    if langs is not None:
        tasks = tasks.withColumn(lang_col, F.explode(F.array(*[F.lit(x) for x in langs])))
    every = [*keys, lang_col]
    todo = unanswered(tasks.select(*every, text_col), read_answers(spark, sink, every), every)
    pending = _scratch(spark, "pending")
    # buckets are finer than units, whose number is known only once the pending requests are written
    files, buckets = int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 20
    todo = todo.withColumn("bucket", F.pmod(F.xxhash64(*every), F.lit(buckets)))
    # a unit lies in several folders, so several tasks read it
    shares = SHARES_PER_FILE * files
    todo = todo.withColumn("share", F.floor(F.col("bucket") * shares / F.lit(float(buckets))).cast("int"))
    task = F.floor(F.col("share") / SHARES_PER_FILE).cast("int")
    todo.repartitionById(files, task).sortWithinPartitions("share", "bucket").write.partitionBy("share").parquet(pending)
    todo = spark.read.schema(todo.schema).parquet(pending)
    units = -(-todo.count() // unit_rows)
    run = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"

    def part(k: int) -> DataFrame:
        """Unit ``k``: a range of buckets, of which only the folders that hold it are opened."""
        first, last = k * buckets // units, (k + 1) * buckets // units - 1
        share = [int(b * shares / float(buckets)) for b in (first, last)]
        return todo.where(F.col("share").between(*share) & F.col("bucket").between(first, last)).drop("bucket", "share")

    parts = (part(k) for k in range(units))

    def finish(raw: DataFrame) -> DataFrame:
        return normalise(raw.withColumnRenamed("answer", "translated"), keys=every, also=("due", "held"))

    _rounds(parts, service, (text_col, lang_col), every, lambda k: f"{sink}/run={run}/unit={k}", finish=finish, **options)
    return read_answers(spark, sink, every)


def send_requests(requests: DataFrame, post: Callable[[str, str], str], *, keys: Sequence[str] = (*DEFAULT_KEYS, "target_lang"), **options) -> DataFrame:
    """Table-driven dispatch: requests(keys, provider, body) from ``build_requests``
    -> responses(keys, provider, reply_style, body, attempts, error).

    ``post(provider, body_json) -> reply_json`` is the caller's transport; cap, rounds and options
    are those of ``translate``, and a reply that does not read as one of the provider's is
    retried like an error. A row without a body (its provider is unknown) is not posted: it
    comes back with 0 attempts and the error ``not sent``. Read the replies with
    ``response.parse_responses`` (in the JVM); a NULL body parses as ``failed``."""
    from versio.operators.services import check_reply
    from versio.sources import dimensions as dims

    keys, spark = list(keys), requests.sparkSession
    todo = requests.select(*keys, "provider", F.col("body").alias("request_body"))

    def call(body: str, provider: str) -> tuple:
        reply = post(provider, body)
        check_reply(provider, reply)
        return reply, {}

    sent = todo.where(F.col("request_body").isNotNull())
    base = _scratch(spark, "replies")
    raw = _rounds([sent], call, ("request_body", "provider"), [*keys, "provider"], lambda k: f"{base}/{k}", **options)
    raw = raw.select(*keys, "provider", F.col("answer").alias("body"), "attempts", "error")
    held = todo.where(F.col("request_body").isNull()).select(
        *keys, "provider", F.lit(None).cast("string").alias("body"), F.lit(0).alias("attempts"), F.lit("not sent").alias("error"))
    styles = dims.providers(spark).select(F.col("provider").alias("__p"), "reply_style")
    return (raw.union(held).join(styles, F.col("provider") == F.col("__p"), "left")
            .select(*keys, "provider", "reply_style", "body", "attempts", "error"))
