"""Repair of conversations against a row by row search."""

import hashlib
import random

from versio.llm import repair as R

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def search(symbols):
    """(cost, audit) of the cheapest edits, the least audit of these, by all ways row by row."""
    def inserted(ways):
        for _ in range(2):
            for i, (c, a) in list(ways.items()):
                for r in "ua":
                    if (i, r) in MOVES:
                        j, new = MOVES[i, r], (c + 5, a + "I")
                        ways[j] = min(ways.get(j, new), new)
        return ways

    ways = {0: (0, "")}
    for s in symbols:
        after = {}
        for i, (c, a) in inserted(ways).items():
            steps = [(i, 2, "D")]
            if s != "x":
                more = 5 if s.isupper() else 0
                steps += [(MOVES[i, r], more + cost, e) for r, cost, e in ((s.lower(), 0, "K"), ("u", 1, "R"), ("a", 1, "R")) if (i, r) in MOVES]
            for j, cost, e in steps:
                new = (c + cost, a + e)
                after[j] = min(after.get(j, new), new)
        ways = after
    return min(w for i, w in inserted(ways).items() if i in (0, 3))


def some_symbols(rng, longest=14):
    weights = rng.choice([[6, 2, 5, 5, 1, 1, 1, 1, 1], [1] * 9, [0, 1, 9, 9, 0, 0, 0, 0, 0]])
    return "".join(rng.choices("xsuaoSUAO", weights, k=rng.randint(1, longest)))


def finish(joiner, done):
    cost, rest, end = joiner.close()
    return cost, "".join(a for _, a, _ in [*done, *rest]) + end


def entries(m):
    return [(i, j, e[0], str(e[1])) for i, row in enumerate(m) for j, e in enumerate(row) if e]


def test_matrices_give_the_cheapest_and_least_audit():
    rng = random.Random(2)
    texts = [some_symbols(rng) for _ in range(400)] + ["ua" * 200, "x" * 300, "s" + "x" * 50, "uaSoU" * 40]
    for text, m in zip(texts, R.block_matrices(texts), strict=True):
        joiner = R.Joiner()
        assert finish(joiner, joiner.add(0, entries(m))) == search(text), text


def test_blocks_of_any_size_join_to_the_same():
    rng = random.Random(4)
    for _ in range(300):
        text = some_symbols(rng, 60)
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 12)))) if len(text) > 1 else []
        blocks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        joiner, done = R.Joiner(), []
        for k, m in enumerate(R.block_matrices(blocks)):
            done += joiner.add(k, entries(m))
        cost, rest, end = joiner.close()
        done += rest
        assert (cost, "".join(a for _, a, _ in done) + end) == search(text)
        assert [b for b, _, _ in done] == list(range(len(blocks)))


def test_what_paths_share_is_let_go():
    joiner = R.Joiner()
    [m] = R.block_matrices(["ua" * 50 + "x"])
    for k in range(200):
        joiner.add(k, entries(m))
        assert len(joiner.open) <= 2 and all(len(a) <= 300 for _, a in joiner.ways.values())


def test_re_pair_is_a_grammar_of_its_texts():
    rng = random.Random(6)
    texts = ["ua" * 64, "", "aaaaaaa", "a", *[some_symbols(rng, 40) for _ in range(100)]]
    rules, short = R.re_pair(texts)

    def spell(s):
        return s if isinstance(s, str) else spell(rules[s][0]) + spell(rules[s][1])

    assert ["".join(map(spell, x)) for x in short] == texts
    assert all(x if isinstance(x, str) else x < k for k, r in enumerate(rules) for x in r)  # parts come first
    pairs = [p for x in short for p in zip(x, x[1:], strict=False) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))  # no pair is left twice
    rules, [short] = R.re_pair(["ua" * 64])
    assert len(rules) + len(short) <= 8  # it grows with the logarithm of the text


def test_ropes_compare_like_strings():
    rng = random.Random(8)
    for _ in range(2000):
        parts = [R.Rope("".join(rng.choice("DIK") for _ in range(rng.randint(0, 40)))) for _ in range(4)]
        a, b = parts[0] + parts[1], (parts[0] + parts[2]) + parts[3]
        assert (a < b) == (str(a) < str(b)) and (b < a) == (str(b) < str(a)) and a.size == len(str(a))


def whole(rows):
    """Audit, counts and repaired lines of one conversation's rows in order, in plain Python."""
    seen, symbols, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    cost, audit = search(symbols)
    lines, k, state = [], 0, 0
    for e in audit:
        if e != "I":
            _, role, text = rows[k]
            k += 1
        if e == "D":
            continue
        if e == "K":
            state = MOVES[state, role[:1]]
            lines.append(f"{role}:{text}")
        else:
            state = 3 if state == 2 else 2
            lines.append(("assistant" if state == 3 else "user") + ":" + ("" if e == "I" else text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *faults.values(), illegal, cost, audit), lines


def repaired(spark, rows, schema="conv_id bigint, turn bigint, role string, text string, n int, id int"):
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    summary, standing = R.repair_conversations(turns)
    facts = {r.conv_id: tuple(r)[1:] for r in summary.collect()}
    lines = {}
    for r in sorted(standing.collect(), key=lambda r: r.number):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    return facts, lines


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BITS", 2)
    rng = random.Random(9)
    rows, want = [], {}
    for conv in [None, *range(12)]:
        own, turn = [], 0
        for k in range(rng.choice([1, 3, 40, 120])):
            turn += rng.choice([1, 1, 1, 2])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "umpire"])
            text = rng.choice(["yes.", " ", "", f"say {k}.", f"say {k}!", f"cut {k}", "again?", "tail \t\n"])
            own += [(turn, role, text)] * rng.choice([1, 1, 1, 1, 3])
        want[conv] = whole(own)
        rows += [(conv, *r) for r in own]
    rng.shuffle(rows)
    facts, lines = repaired(spark, rows)
    assert facts == {c: w[0] for c, w in want.items()}
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_cases(spark):
    long = "x" * 300_000 + "."
    rows = [(1, None, "user", "first."), (1, 3, "assistant", "then."), (1, 3, "assistant", "then."),
            (2, 1, None, None), (3, 1, "user", long), (3, 2, "assistant", long), (4, None, "assistant", "a."), (5, 7, "system", "s.")]
    facts, lines = repaired(spark, rows)
    assert facts[1] == (0, 0, 1, 0, 1, 2, "KKD") and lines[1] == ["user:first.", "assistant:then."]
    assert facts[2] == (0, 1, 0, 0, 0, 2, "D") and 2 not in lines
    assert facts[3][-1] == "KK" and lines[3] == ["user:" + long, "assistant:" + long]
    assert facts[4] == (0, 0, 0, 0, 0, 2, "D") and facts[5] == (0, 0, 0, 0, 0, 2, "D")
    summary, standing = R.repair_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert summary.collect() == [] and standing.collect() == []


def test_one_row_many_times(spark):
    rows = [(1, 1, "user", "same.")] * 5000 + [(1, 2, "assistant", "same.")] + [(1, 3, "user", "same.")] * 3000
    facts, lines = repaired(spark, rows)
    assert facts[1] == (0, 0, 7999, 0, 4999 + 2999, 2 * 7999, "K" + "D" * 4999 + "K" + "D" * 3000)
    assert lines[1] == ["user:same.", "assistant:same."]


def test_digests_of_lines(spark):
    rows = [(1, 2, "b"), (1, 10, "c"), (1, 1, "a"), (None, 0, "z"), (2, 0, "")]
    got = {r.k: r.d for r in R.digest_lines(spark.createDataFrame(rows, "k int, o int, line string"), "k", "o", "line", "d").collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((1, "a\nb\nc"), (None, "z"), (2, ""))}
