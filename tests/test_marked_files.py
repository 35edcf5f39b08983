"""Pages of marker-separated files whatever the blocks they are read in."""

import os
import random

import pytest
from pyspark.sql import functions as F

from versio.functions.text import PAGE_MARKER
from versio.sources import marked_files
from versio.sources.marked_files import marked_file_pages


@pytest.fixture
def blocks(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path):
    got = {}
    for r in marked_file_pages(spark, path).collect():
        got.setdefault(os.path.basename(r.doc_id), []).append((r.page_idx, r.page))
    return {name: sorted(pages) for name, pages in got.items()}


def write(folder, texts):
    want = {}
    for name, text in texts.items():
        (folder / name).write_text(text)
        kept = [p.strip() for p in text.split(PAGE_MARKER) if p.strip()]
        if kept:
            want[name] = list(enumerate(kept))
    return want


def test_pages_do_not_depend_on_the_blocks(spark, tmp_path, blocks):
    rng = random.Random(5)
    parts = ["", "a", " \n", "x\ny\r\nz", "<<<", "<", "<<<PAGE_", "é" * 9, "word " * 40, " "]
    texts = {f"f{k}.txt": PAGE_MARKER.join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for k in range(4)}
    texts |= {"empty.txt": "", "marks.txt": PAGE_MARKER * 5, "ends.txt": PAGE_MARKER + "a" + PAGE_MARKER, "none.txt": "no marker\n"}
    want = write(tmp_path, texts)
    for n in (33, 50, 400, 100_000):
        blocks(n)
        assert read(spark, str(tmp_path)) == want, n


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, blocks, monkeypatch):
    want = write(tmp_path, {"hot.txt": PAGE_MARKER.join(f"page {k} " + "text " * 50 for k in range(2000)), "small.txt": "one" + PAGE_MARKER + "two"})
    blocks(20_000)
    pages = marked_file_pages(spark, str(tmp_path))
    assert pages.where("doc_id like '%hot.txt'").select(F.spark_partition_id()).distinct().count() > 10
    assert read(spark, str(tmp_path)) == want
    monkeypatch.setattr(marked_files, "BROADCAST_BLOCKS", 0)  # the other way to join gives the same
    assert read(spark, str(tmp_path)) == want


def test_text_is_not_shuffled(spark, tmp_path):
    write(tmp_path, {"a.txt": "a" + PAGE_MARKER + "b", "b.md": "c"})
    plan = marked_file_pages(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert [r.page for r in marked_file_pages(spark, str(tmp_path), glob="*.md").collect()] == ["c"]
