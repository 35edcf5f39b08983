import re

from pyspark.sql import functions as F

from versio.llm import cdc_dedup, exact_dedup, mixing
from versio.llm.exact_dedup import exact_duplicates, keep_first


def test_exact_cases(spark):
    rows = [(1, "a b"), (2, "ab  "), (3, "a\tb\n\x0b"), (4, None), (5, ""), (6, " "), (7, "unique"), (8, "uniquf"), (9, "x" * 300 + "a"), (10, "x" * 300 + "b"),
            (11, "a b"), (3, "a\tb\n\x0b"), (None, "ab"), (None, "nameless"), (12, "w " * 300_000), (13, "w  " * 300_000), (7, "other text, same id")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id bigint, text string, keep_id int")
    got = exact_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.keep_id for k in (1, 2, 3) for r in by[k]} == {3} and by[1][0].group_size == 5
    assert sorted(r.kept for r in by[3]) == [False, True]
    assert by[4][0].keep_id == by[5][0].keep_id == by[6][0].keep_id == 6
    assert all(by[k][0].kept and by[k][0].group_size == 1 for k in (8, 9, 10, 11))
    assert by[12][0].keep_id == 13 and not by[12][0].kept
    assert sorted((r.kept, r.keep_id) for r in by[None] if not r.kept) == [(False, 3)]
    assert len([r for r in by[7] if r.kept]) == 2
    kept = keep_first(df)
    assert kept.columns == df.columns
    text = sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect())
    assert text == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    assert exact_duplicates(df.limit(0)).count() == 0 and keep_first(df.limit(0)).count() == 0


def test_exact_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for out in (exact_duplicates(df), keep_first(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_refinement_does_not_depend_on_the_table_size(spark, monkeypatch):
    rows = [(k, "t" * (k % 7) + str(k % 11)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(exact_duplicates(df).collect())
    monkeypatch.setattr(exact_dedup, "SLOTS", 1)
    monkeypatch.setattr(exact_dedup, "PREFIX", 1)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect())
    assert got == [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in want]


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, copy string")
    return mixing.replicate(df, **more)


def test_mixing_rates(spark):
    rows = [(k, "a" if k % 10 else "b", "x") for k in range(4000)]
    out = mixed(spark, rows, weights={"a": 1.0, "b": 3.0}, total=8000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 6000) < 300
    assert out.columns == ["doc_id", "source", "copy", "shuffle_key"]
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)  # partitions are ranges, rows are sorted
    assert sorted(out.collect()) == sorted(mixed(spark, rows, weights={"a": 1.0, "b": 3.0}, total=8000).collect())


def test_mixing_by_broadcast_and_by_salt_is_equal(spark, monkeypatch):
    from versio.llm import common

    rows = [(k, f"s{k % 13}", "x") for k in range(500)]
    want = sorted(mixed(spark, rows).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert sorted(mixed(spark, rows).collect()) == want


def test_mixing_cases(spark):
    rows = [(1, None, "x"), (2, "a", None), (2, "a", None), (None, "a", "x"), (3, "zero", "x")]
    out = mixed(spark, rows, weights={None: 1.0, "a": 1.0}, total=4000).collect()
    assert {r.source for r in out} <= {None, "a"} and any(r.source is None for r in out)
    assert len([r for r in out if r.doc_id == 2]) % 2 == 0  # repeated rows have one count
    assert mixed(spark, rows, weights={}).count() == 0
    assert mixed(spark, []).count() == 0


def test_chunks_are_whole_and_resist_insertion():
    import numpy as np

    text = ("Ärger über viele Wörter und noch mehr davon, " * 3 + "unterschiedliche Dinge folgen hier; Zahlen 123456789 auch. ") * 40
    raw = text.encode()
    ends = cdc_dedup.cuts(np.frombuffer(raw, np.uint8))
    parts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    assert b"".join(parts) == raw and all(p.decode() for p in parts)
    moved = b"inserted at the front: " + raw
    ends2 = cdc_dedup.cuts(np.frombuffer(moved, np.uint8))
    parts2 = [moved[a:b] for a, b in zip([0, *ends2[:-1].tolist()], ends2.tolist(), strict=True)]
    assert len(set(parts) - set(parts2)) <= 2
    assert len(cdc_dedup.cuts(np.zeros(0, np.uint8))) == 0
    same = cdc_dedup.cuts(np.zeros(5000, np.uint8))
    assert same[-1] == 5000 and max(np.diff([0, *same])) <= 1024


def test_gear_hash_equals_the_rolling_form_and_pieces_do_not_matter(monkeypatch):
    import numpy as np

    data = np.random.default_rng(3).integers(0, 256, 3000, np.uint8) & np.uint8(0x7F)
    h, rolling = 0, []
    for b in data.tolist():
        h = (2 * h + int(cdc_dedup.GEAR[b])) % 2**32
        rolling.append(h)
    assert cdc_dedup.gear_hash(data).tolist() == rolling
    want = cdc_dedup.cuts(data).tolist()
    monkeypatch.setattr(cdc_dedup, "PIECE", 100)
    assert cdc_dedup.cuts(data).tolist() == want


def test_substring_cases(spark):
    import random

    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))

    passage, short = words(70), words(20)
    rows = [(3, words(30) + " " + passage + " " + words(40)), (8, passage + " " + words(10)), (11, words(50) + short), (12, short + " " + words(60)),
            (13, None), (14, ""), (15, "  "), (None, passage), (16, words(40)), (16, words(10) + passage), (17, words(100_000))]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, digest int")
    spans = cdc_dedup.repeated_spans(df)
    got = spans.collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(8, 3), (16, 3)}
    cleaned = {r.doc_id: r.text for r in cdc_dedup.without_repeats(df.where("doc_id <> 16"), spans).collect()}
    assert len(cleaned[8]) < len(rows[1][1]) - 250 and cleaned[3] == rows[0][1] and cleaned[13] is None
    assert cdc_dedup.repeated_spans(df.limit(0)).count() == 0


def test_uniform_is_between_0_and_1(spark):
    r = spark.range(1000).select(mixing.uniform(F.lit(1), F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.05


def test_substring_passages_just_over_the_least_length(spark):
    import random

    rng = random.Random(11)

    def words(n, low, high):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high))) for _ in range(n))

    rows, want, k = [], {}, 0
    for low, high in ((2, 9), (3, 6), (1, 5), (1, 3), (1, 1)):
        for n in (49, 50, 51, 55):
            for _ in range(20):
                passage = words(n, low, high)
                rows += [(k, f"{words(9, 2, 9)} a{k}a {passage} b{k}b {words(9, 2, 9)}"), (k + 1, f"{words(30, 2, 9)} c{k}c {passage} d{k}d")]
                if n >= 50:
                    want[k + 1] = (k, len(rows[-1][1].split(passage)[0]), len(passage), n)
                k += 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in cdc_dedup.repeated_spans(df).collect()}
    assert got == want
    less = words(20, 1, 1)
    df = spark.createDataFrame([(1, f"first {less} ends"), (2, f"the second {less} stops")], "doc_id bigint, text string")
    assert [tuple(r)[:5] for r in cdc_dedup.repeated_spans(df, least_words=20).collect()] == [(2, 1, 11, 39, 20)]


def test_substring_passages_of_one_word_and_of_common_phrases(spark):
    # every phrase of the passage of 4 and 5 is in a smaller document too, the passage is not
    phrases = [f"phrase number {k} of the many that all of these texts hold in common" for k in range(5)]
    rows = [(k, f"x{k}x {p} y{k}y") for k, p in enumerate(phrases[:4])] + [(4, "u " + " ".join(phrases)), (5, "v " + " ".join(phrases) + " w")]
    rows += [(6, "one " + "again " * 60 + "six"), (7, "two " + "again " * 51 + "seven")]
    got = {r.doc_id: tuple(r)[1:5] for r in cdc_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: (4, 2, len(" ".join(phrases)), 70), 7: (6, 4, 6 * 51 - 1, 51)}


def test_exact_tells_apart_texts_of_one_id_and_one_length(spark):
    rows = [(0, "abcd"), (0, "abce"), (0, "wxyz"), (None, "abcd"), (None, "abcf"), (None, "abcg"), (1, "q" * 9), (1, "r" * 9), (1, "r" * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(False, 0, 0, 1, True), (False, 0, 0, 1, True), (False, 0, 0, 2, True), (False, 1, 1, 1, True), (False, 1, 1, 2, False), (False, 1, 1, 2, True)]
    want = [(0, "abcd"), (0, "abce"), (0, "wxyz"), (1, "q" * 9), (1, "r" * 9), (None, "abcf"), (None, "abcg")]
    assert sorted(map(str, map(tuple, keep_first(df).collect()))) == sorted(map(str, want))


def test_substring_spans_of_ids_with_several_texts(spark):
    import random

    rng = random.Random(13)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))

    for n, offset in ((50, 20), (50, 30), (60, 30)):
        rows, want = [], set()
        for k in range(60):
            held = [words(n), words(n)]
            rows.append((k, f"{words(8)} {held[0]} {words(8)} {held[1]} end{k}"))
            for p in held:  # two texts of one id, each with a passage of its own
                rows.append((1000 + k, f"{words(offset)} x{k}x {p} y{k}y"))
                want.add((1000 + k, k, len(rows[-1][1].split(p)[0]), len(p)))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        spans = cdc_dedup.repeated_spans(df)
        assert {tuple(r)[:4] for r in spans.collect()} == want
        cleaned = sorted(r.text for r in cdc_dedup.without_repeats(df, spans).where("doc_id >= 1000").collect())
        assert len(cleaned) == 120 and all(len(t.split()) == offset + 2 for t in cleaned)
