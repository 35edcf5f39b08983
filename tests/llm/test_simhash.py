import random

import numpy as np
import pytest

from brute import components, simhash
from versio.llm.components import connected_components
from versio.llm.simhash import chain_forest, fingerprint, links, ring_keys, segments, simhash_components


def test_fingerprint_equals_plain_python():
    for text in (None, "", " \n\t", "one", "One two", "A b c", "a b c a b c", "É é É", "x " * 70000, "a\x0bb\x0cc\rd", "a\x85b\xa0c d"):
        assert fingerprint((text or "").encode() if text is not None else None, 3) == simhash(text, 3)


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("dense", [1, 4, 512])
def test_components_equal_all_pairs(spark, bits, dense):
    if bits == 3 and dense == 1:
        dense = 2
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for s in seeds:  # chains and clouds around each
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                s ^= 1 << rng.randrange(64)
            prints.add(s)
    fps = dict(enumerate(sorted(prints)))
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in fps.items()]
    df = spark.createDataFrame(signed, "id bigint, fp bigint")
    got = {r.node: r.root for r in connected_components(links(df.select("fp"), bits, dense)).collect()}
    want = components(fps, bits)
    by = dict(signed)
    groups, wanted = {}, {}
    for k, f in signed:
        groups.setdefault(got.get(f, f), set()).add(k)
        wanted.setdefault(want[k], set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert len(by) == len(fps)


def test_ring_covers_64_bits_and_forest_is_within_budget():
    for t in range(1, 8):
        ring = segments(t)
        assert sum(w for _, w in ring) == 64 and ring[0][0] == 0 and len(ring) == t + 1
    a = np.array([0, 1 << 63, 3 << 62, 7 << 61], np.uint64).view(np.int64)
    assert len(chain_forest(np.sort(a), 0, 2)) == 3


def test_cases(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "  ", "c"), (7, "same words here", "c"), (5, "Same WORDS\there", "c"), (5, "Same WORDS\there", "c"),
            (None, "same words here", "c"), (None, "lonely text of a null id", "c"), (9, "x " * 200_000, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(df).collect() if r.doc_id is not None)
    assert len(got) == 7
    by = {g[1]: g for g in got}
    assert by[1][2] == "0" * 16 and by[2][3] == by[3][3] == by[1][3] == 1
    assert by[7][3] == by[5][3] == 5
    nulls = [r for r in simhash_components(df).collect() if r.doc_id is None]
    assert sorted((r.component_id is None, r.component_id) for r in nulls) == [(False, 5), (True, None)]
    empty = simhash_components(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (None, 3), (2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(300)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
