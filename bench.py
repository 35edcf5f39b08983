"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver): one warm-up run, then the best
of ``BENCH_REPEATS`` (default 2) timed runs, each on a freshly built plan.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from versio.plans.catalog import QUERIES  # noqa: E402
from versio.session import local_session  # noqa: E402

HEADLINE = [
    "chunks_2000",
    "chunks_200",
    "chunks_20",
    "chunks_native_200",
    "split_pages",
    "extract_best",
    "extract_candidates",
    "build_requests",
    "translate_failures",
    "reassemble",
    "usage_report",
    "translate_documents",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def chunk_stage(spark, sf_dir: str, cpus: int, repeats: int) -> dict:
    """
    repartitioned to the core count and cached, count + character sum of the
    chunks as the action, best of the timed passes after a warm-up."""
    from pyspark.sql import functions as F

    from versio.operators.chunk import chunk_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(cpus).cache()
    docs.count()
    out = {}
    def stage(limit):
        # a fresh DataFrame per pass: re-collecting one object would reuse its shuffle output
        return chunk_documents(docs, limit).agg(F.count(F.lit(1)), F.sum(F.length("chunk")))

    for limit in (20, 200, 2000):
        stage(limit).collect()
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            stage(limit).collect()
            best = min(best, time.perf_counter() - t0)
        out[f"chunk_stage_cached_{limit}"] = round(best, 3)
    docs.unpersist()
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {}
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    for name in names:
        q = QUERIES[name]
        run(q(spark, sf_dir))  # warm-up: Python workers, JIT, file listing
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(q(spark, sf_dir))
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    if os.environ.get("BENCH_STAGES", "1") == "1":
        times.update(chunk_stage(spark, sf_dir, int(cpus), repeats))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
