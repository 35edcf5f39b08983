"""Repair of the structure of conversations by a grammar-compressed dynamic programme.

A conversation is a sequence of symbols: the initial of each row's role and
whether the row must go (blank, duplicate) or breaks off (truncated). The
cheapest edits that give role initials ``(s?(ua)+)?`` are a shortest path
through the automaton of that pattern, so a stretch of rows is a matrix over
(cost, audit) from state to state, and stretches are joined by the min-plus
product. The product is associative; therefore

* rows are ordered by a range partitioning that splits a long conversation, and
  cut into blocks of bounded length;
* within a batch of blocks Re-Pair replaces the most frequent pair of symbols by
  a rule again and again; each rule has one matrix, made from those of its two
  parts and shared by all conversations. Audits are ropes, joined without
  copying and written out only for a block's result;
* the blocks of a conversation are joined in order by a pass over narrow rows,
  which settles what all paths agree on as it goes.

Of equally cheap audits the ASCII-least is taken. Two such audits of the same
rows never begin with one another (the longer would cost an insertion more), so
the least of a whole is made of the least of its parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import join_keys, written

#: Rows of a block: blocks are numbered along the ordered rows.
BLOCK_BITS = 12
#: White space in the sense of this module.
_BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of keeping a row that breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: States in which a conversation may end.
_FINAL = (START, ASSISTANT)


class Rope:
    """A text made of two ropes or of a string."""

    __slots__ = ("left", "right", "string", "size")

    def __init__(self, string: str = "", left: Rope | None = None, right: Rope | None = None) -> None:
        self.left, self.right, self.string = left, right, string
        self.size = left.size + right.size if left is not None else len(string)

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.size + other.size <= 32:
            return Rope(str(self) + str(other))
        return Rope(left=self, right=other)

    def pieces(self) -> Iterator[str]:
        stack = [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                yield rope.string
            else:
                stack += (rope.right, rope.left)

    def __str__(self) -> str:
        return self.string if self.left is None else "".join(self.pieces())

    def __lt__(self, other: Rope) -> bool:
        a, b = self, other
        while a is not b and a.left is not None and b.left is not None:  # what is shared needs no comparison
            if a.left is b.left:
                a, b = a.right, b.right
            elif a.right is b.right and a.left.size == b.left.size:
                a, b = a.left, b.left
            else:
                break
        if a is b:
            return False
        mine, theirs, x, y = a.pieces(), b.pieces(), "", ""
        while True:
            x, y = x or next(mine, ""), y or next(theirs, "")
            n = min(len(x), len(y))
            if not n:
                return len(x) < len(y)
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]


#: Row by row the (cost, audit) from a state to a state; None where there is no way.
Matrix = list[list[tuple[int, Rope] | None]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: of all ways through a middle state the cheapest, then the least audit."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i, row in enumerate(a):
        for k, first in enumerate(row):
            if first is None:
                continue
            for j, second in enumerate(b[k]):
                if second is None:
                    continue
                cost, best = first[0] + second[0], out[i][j]
                if best is None or cost < best[0]:
                    out[i][j] = (cost, first[1] + second[1])
                elif cost == best[0]:
                    audit = first[1] + second[1]
                    if audit < best[1]:
                        out[i][j] = (cost, audit)
    return out


def _insertions() -> Matrix:
    """No insertion, one, or two: more never lead to a state more cheaply."""
    none: Matrix = [[(0, Rope()) if i == j else None for j in range(4)] for i in range(4)]
    step: Matrix = [[min(((INSERT, Rope("I")) for r in "ua" if _NEXT.get((i, r)) == j), default=none[i][j]) for j in range(4)] for i in range(4)]
    return product(step, step)


INSERTIONS = _insertions()
#: What a way in state i needs at most to go on as one in state j does: the cost, and the insertions after which the
#: same edits follow (None where one of them may differ: a system turn that is kept there is deleted here).
FOLLOW = {
    (START, SYSTEM): (0, ""), (START, USER): (INSERT, "I"), (START, ASSISTANT): (0, ""),
    (SYSTEM, START): (2 * INSERT + DELETE, None), (SYSTEM, USER): (INSERT, "I"), (SYSTEM, ASSISTANT): (2 * INSERT, "II"),
    (USER, START): (INSERT + DELETE, None), (USER, SYSTEM): (INSERT, "I"), (USER, ASSISTANT): (INSERT, "I"),
    (ASSISTANT, START): (DELETE, None), (ASSISTANT, SYSTEM): (0, ""), (ASSISTANT, USER): (INSERT, "I"),
}


def symbol_matrix(symbol: str) -> Matrix:
    """Matrix of one row: insertions before it, then its edit. ``x``: the row must go; else the initial of its
    role (``o``: any other), as a capital if the text breaks off."""
    edit: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        edit[i][i] = (DELETE, Rope("D"))
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            ways = [(extra, "K", symbol.lower()), (extra + REROLE, "R", "u"), (extra + REROLE, "R", "a")]
            for cost, letter, role in ways:
                j = _NEXT.get((i, role))
                if j is not None and (edit[i][j] is None or (cost, letter) < (edit[i][j][0], str(edit[i][j][1]))):
                    edit[i][j] = (cost, Rope(letter))
    return product(INSERTIONS, edit)


TERMINALS = {c: symbol_matrix(c) for c in "xsuaoSUAO"}


def re_pair(texts: Sequence[str]) -> tuple[list[tuple], list[list]]:
    """Re-Pair over several texts: (rules, compressed texts). Symbols are characters or numbers of rules; a rule
    is a pair of symbols. The most frequent pair goes first, until no pair occurs twice."""
    symbols: list = []
    ends = []
    for text in texts:
        symbols += [*text, None]
        ends.append(len(symbols) - 1)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    places: dict[tuple, set[int]] = defaultdict(set)
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if None not in pair:
            places[pair].add(i)
    order: dict[tuple, int] = {pair: k for k, pair in enumerate(places)}  # ties: the pair met first
    heap = [(-len(p), order[pair], pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple] = []
    while heap:
        count, _, pair = heapq.heappop(heap)
        here = places[pair]
        if len(here) != -count:  # what became rarer is queued again
            if 1 < len(here) < -count:
                heapq.heappush(heap, (-len(here), order[pair], pair))
            continue
        name, grown = len(rules), set()
        made = 0
        for i in sorted(here):
            j = after[i]
            if i not in here or j >= len(symbols) or (symbols[i], symbols[j]) != pair:
                continue  # overlapped by the one before
            h, k = before[i], after[j]
            if h >= 0 and symbols[h] is not None:
                places[symbols[h], symbols[i]].discard(h)
                places[symbols[h], name].add(h)
                grown.add((symbols[h], name))
            if k < len(symbols) and symbols[k] is not None:
                places[symbols[j], symbols[k]].discard(j)
                places[name, symbols[k]].add(i)
                grown.add((name, symbols[k]))
            here.discard(i)
            symbols[i], symbols[j] = name, None
            after[i] = k
            if k < len(symbols):
                before[k] = i
            made += 1
        here.clear()
        if not made:
            continue
        rules.append(pair)
        for p in grown:
            order.setdefault(p, len(order))
            if len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), order[p], p))
    out, at = [], 0
    for end in ends:
        text = []
        while at < end:
            text.append(symbols[at])
            at = after[at]
        out.append(text)
        at = end + 1
    return rules, out


def block_matrices(texts: Sequence[str]) -> list[Matrix]:
    """The matrix of each text, by a grammar that all of them share."""
    distinct = list(dict.fromkeys(texts))
    rules, short = re_pair(distinct)
    matrices: dict = dict(TERMINALS)
    for name, (left, right) in enumerate(rules):  # a rule's parts come before it
        matrices[name] = product(matrices[left], matrices[right])
    made = {}
    for text, symbols in zip(distinct, short, strict=True):
        total = matrices[symbols[0]]
        for s in symbols[1:]:
            total = product(total, matrices[s])
        made[text] = total
    return [made[t] for t in texts]


class Joiner:
    """Joins the matrices of one conversation's blocks in order. ``add`` and ``close`` give the blocks that are
    settled, each as (block, audit, state before it); what all paths still share is settled and let go."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}  # state: cost, audit since the settled blocks
        self.open: list[tuple[int, dict[int, tuple[int, str]]]] = []  # block, state after it: state before it, audit
        self.roots: dict[int, int] = {}  # state: the state that its path had after the first open block

    def add(self, block: int, entries: Iterable[tuple[int, int, int, str]]) -> list[tuple[int, str, int]]:
        """``entries``: (state before, state after, cost, audit)."""
        ways: dict[int, tuple[int, str]] = {}
        steps: dict[int, tuple[int, str]] = {}
        for i, j, cost, audit in entries:
            if i in self.ways:
                way = (self.ways[i][0] + cost, self.ways[i][1] + audit)
                if j not in ways or way < ways[j]:
                    ways[j], steps[j] = way, (i, audit)
        # a way goes if another one can follow it from here on and comes out better whatever is to come
        def beaten(j: int) -> bool:
            for i, (cost, audit) in ways.items():
                if i != j:
                    more, first = FOLLOW[i, j]
                    if cost + more < ways[j][0] or (first is not None and (cost + more, audit + first) < ways[j]):
                        return True
            return False

        self.ways = {j: way for j, way in ways.items() if not beaten(j)}
        self.roots = {j: self.roots[steps[j][0]] if self.open else j for j in self.ways}
        self.open.append((block, steps))
        return self._settle() if len(set(self.roots.values())) == 1 else []

    def _settle(self) -> list[tuple[int, str, int]]:
        """The blocks up to the last one after which all paths are in one state."""
        at, back = len(self.open), {j: j for j in self.ways}  # state now: state after block number at - 1
        later = back
        while len(set(back.values())) > 1:
            at, later = at - 1, back
            back = {j: self.open[at][1][i][0] for j, i in back.items()}
        done = self._trace(next(iter(back.values())), at)
        self.roots = later if self.open else {}
        cut = sum(len(x[1]) for x in done)
        self.ways = {j: (cost, audit[cut:]) for j, (cost, audit) in self.ways.items()}
        return done

    def _trace(self, state: int, upto: int) -> list[tuple[int, str, int]]:
        done = []
        for block, steps in reversed(self.open[:upto]):
            before, audit = steps[state]
            done.append((block, audit, before))
            state = before
        self.open = self.open[upto:]
        return done[::-1]

    def close(self) -> tuple[int, list[tuple[int, str, int]], str]:
        """(cost, the blocks left, insertions after the last row)."""
        ends = []
        for state, (cost, audit) in self.ways.items():
            for final in _FINAL:
                if INSERTIONS[state][final] is not None:
                    more, rope = INSERTIONS[state][final]
                    ends.append((cost + more, audit + str(rope), state, str(rope)))
        cost, _, state, last = min(ends)
        return cost, self._trace(state, len(self.open)), last


def _visible(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def _before(turn: Column) -> Column:
    """Turns in order, nulls first."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def with_faults(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Equal rows as one: (id, turn, role, text, mark, n, fault), where ``fault`` (blank, duplicate, truncated or
    null) is that of the first of the ``n`` rows and the others are blank or duplicate."""
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit(" ")), F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    mark = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    rows = written(rows.groupBy("id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", mark), "turns")
    # a text said in several turns; most are not, so the table joined is short
    said = rows.groupBy("id", "mark").agg(F.min(_before(F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("times"))
    again = said.where("times > 1").select("id", "mark", "first")
    rows = join_keys(rows, again, ("id", "mark"), F.xxhash64("turn"))
    visible = _visible(F.col("text"))
    fault = (F.when(visible == "", "blank").when(F.col("first") < _before(F.col("turn")), "duplicate")
             .when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return rows.withColumn("fault", fault).drop("first")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_faults`` with ``pos``, which grows along the order of conversation, turn (nulls first)
    and mark. The sampled bounds of the ranges split a long conversation."""
    keys = [F.col(c).asc_nulls_first() for c in ("id", "turn", "mark")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(ranged.withColumn("pos", F.monotonically_increasing_id()), "ordered-turns")


def _blocks(rows: DataFrame) -> DataFrame:
    """(id, block, places, copies, symbols, initials): a block's rows as strings, one character a row, with the
    place and the number of copies of each row of the table."""
    block = F.shiftright("pos", BLOCK_BITS)
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    must_go = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    symbol = F.when(must_go, "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    row = F.struct("pos", "n", symbol.alias("symbol"), known.alias("initial"))
    whole = rows.groupBy("id", block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    times = lambda c, r: F.repeat(c, r.cast("int"))
    return whole.select(
        "id", "block", F.transform("rows", lambda r: r["pos"]).alias("places"), F.transform("rows", lambda r: r["n"]).alias("copies"),
        F.array_join(F.transform("rows", lambda r: F.concat(r["symbol"], times(F.lit("x"), r["n"] - 1))), "").alias("symbols"),
        F.array_join(F.transform("rows", lambda r: times(r["initial"], r["n"])), "").alias("initials"))


def _illegal(initials: str) -> int:
    """Neighbours that are not su, ua or au."""
    return len(initials) - 1 - sum(initials.count(p) for p in ("su", "ua", "au"))


def _with_matrices(blocks: DataFrame) -> DataFrame:
    """(id, block, illegal, head, tail, entries): the matrix of each block, by a grammar of each batch."""
    entry = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, initials = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            entries = []
            for m in block_matrices(symbols):
                entries.append([{"i": i, "j": j, "cost": e[0], "audit": str(e[1])} for i, row in enumerate(m) for j, e in enumerate(row) if e is not None])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(_illegal, initials), pa.int64()), pa.array([x[0] for x in initials], pa.string()),
                 pa.array([x[-1] for x in initials], pa.string()), pa.array(entries, pa.list_(entry))], ["id", "block", "illegal", "head", "tail", "entries"])

    kind = blocks.schema["id"].dataType.simpleString()
    return blocks.select("id", "block", "symbols", "initials").mapInArrow(
        run, f"id {kind}, block bigint, illegal bigint, head string, tail string, entries array<struct<i: int, j: int, cost: bigint, audit: string>>")


def _joined(blocks: DataFrame) -> DataFrame:
    """Blocks joined along each conversation: a row (id, block, audit, state, made) for each block, ``made`` being the
    number of turns that stand before it, and a last row (block null) with cost, illegal and the insertions at the end."""
    names = ["id", "block", "audit", "state", "made", "cost", "illegal"]
    kinds = [None, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, now, tail, illegal, made, begun, kind = Joiner(), None, "", 0, 0, False, None

        def settled(done: list[tuple[int, str, int]]) -> list[tuple]:
            nonlocal made
            rows = []
            for block, audit, state in done:
                rows.append((now, block, audit, state, made, None, None))
                made += len(audit) - audit.count("D")
            return rows

        def last() -> list[tuple]:
            cost, done, end = joiner.close()
            rows = settled(done)
            return [*rows, (now, None, end, None, made, cost, illegal)]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind, out = batch.column(0).type, []
            for key, block, bad, head, end, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != now:
                    if begun:
                        out += last()
                    joiner, now, tail, illegal, made, begun = Joiner(), key, "", 0, 0, True
                illegal += bad + (1 if tail and tail + head not in ("su", "ua", "au") else 0)
                tail = end
                out += settled(joiner.add(block, ((e["i"], e["j"], e["cost"], e["audit"]) for e in entries)))
            if out:
                yield table(out)
        if begun:
            yield table(last())

    id_type = blocks.schema["id"].dataType.simpleString()
    arranged = blocks.repartition(F.col("id")).sortWithinPartitions("id", "block")
    return arranged.select("id", "block", "illegal", "head", "tail", "entries").mapInArrow(
        run, f"id {id_type}, block bigint, audit string, state int, made bigint, cost bigint, illegal bigint")


def _edits(blocks: DataFrame) -> DataFrame:
    """(id, pos, number, edit, role): the turns that stand after the edits, in order of ``number``; ``pos`` is null for
    an inserted one, ``role`` for one that keeps its own."""
    names = ["id", "pos", "number", "edit", "role"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(key: object, audit: str, state: int, made: int, places: list[int] | None, copies: list[int] | None, symbols: str | None) -> Iterator[tuple]:
        row, left, k = -1, 0, 0
        for letter in audit:
            pos = None
            if letter != "I":
                if not left:
                    row += 1
                    left = copies[row]
                pos, left = places[row], left - 1
                symbol = symbols[k]
                k += 1
                if letter == "D":
                    continue
            if letter == "K":
                state, role = _NEXT[state, symbol.lower()], None
            else:
                role = "assistant" if state == USER else "user"
                state = ASSISTANT if state == USER else USER
            yield key, pos, made, letter, role
            made += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in one(*x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k or part.column(0).type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    id_type = blocks.schema["id"].dataType.simpleString()
    return blocks.select("id", "audit", "state", "made", "places", "copies", "symbols").mapInArrow(
        run, f"id {id_type}, pos bigint, number bigint, edit string, role string")


def repair_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. One row for each conversation: id, ``gaps`` (turn numbers missing between the smallest and the
    largest), ``blank``, ``duplicate`` and ``truncated`` (rows by their first fault), ``illegal`` (neighbours whose role
    initials are not su, ua or au), ``cost`` and ``audit``, the letter of every edit in order: K keep, R give the row
    the role user or assistant, D delete, I insert an empty turn. And one row for each turn that stands after the edits:
    id, ``number`` (from 0), ``edit``, ``role``, ``text``.

    Rows go by turn, nulls first; rows of one turn by a digest of role and text. A null role or text counts as one
    space. Rows with a null id form one conversation. Equal rows are duplicates of one another. Texts and
    conversations may be of any length; a conversation's audit is one value. An empty table gives no rows; other
    columns are not read.
    """
    faulty = with_faults(turns, id_col, turn_col, role_col, text_col)
    rows = ordered(faulty)
    first = lambda name: F.coalesce((F.col("fault") == name).cast("int"), F.lit(0))
    blank, dup = first("blank"), first("duplicate")
    facts = rows.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(blank * F.col("n")).alias("blank"),
        F.sum(dup + F.when(blank == 0, F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum(first("truncated")).alias("truncated"))
    blocks = written(_blocks(rows), "blocks")
    joined = written(_joined(_with_matrices(blocks)), "joined-blocks")
    # the audit of a conversation: those of its blocks in order, the insertions at the end last
    piece = F.struct(F.col("block").isNull().alias("end"), "block", "audit")
    audits = joined.groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["audit"]), "").alias("audit"),
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    key = facts.withColumnRenamed("id", "other")
    summary = audits.join(key, F.col("id").eqNullSafe(F.col("other"))).select(
        F.col("id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    with_rows = joined.where("block is not null").select(F.col("id").alias("own"), F.col("block").alias("at"), "audit", "state", "made").join(
        blocks, F.col("own").eqNullSafe(F.col("id")) & (F.col("at") == F.col("block")))
    at_end = joined.where("block is null and audit <> ''").select("id", "audit", F.lit(None).cast("int").alias("state"), "made")
    ends = _inserted(at_end)
    edits = _edits(with_rows)
    texts = rows.select(F.col("pos").alias("place"), F.col("role").alias("old"), "text")
    kept = edits.where("pos is not null").join(texts, F.col("pos") == F.col("place")).select(
        "id", "number", "edit", F.coalesce("role", "old").alias("role"), "text")
    added = edits.where("pos is null").select("id", "number", "edit", "role", F.lit("").alias("text"))
    standing = kept.unionByName(added).unionByName(ends)
    return summary, standing.withColumnRenamed("id", id_col)


def _inserted(ends: DataFrame) -> DataFrame:
    """The turns inserted after the last row: an assistant, or a user and an assistant."""
    roles = F.when(F.length("audit") == 1, F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    return ends.select("id", "made", F.posexplode(roles).alias("k", "role")).select(
        "id", (F.col("made") + F.col("k")).alias("number"), F.lit("I").alias("edit"), "role", F.lit("").alias("text"))


def digest_lines(lines: DataFrame, key: str, order: str, line: str, digest: str) -> DataFrame:
    """(key, digest): SHA-256 of each key's lines in order, with line feeds between. A digest is made of a sequence,
    so a key's lines meet one task, which reads them one by one and keeps none."""
    arranged = lines.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(line).alias("line"))
    arranged = arranged.repartition(F.col("key")).sortWithinPartitions("key", "order").select("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun, kind = None, hashlib.sha256(), False, None
        for batch in batches:
            kind, done = batch.column(0).type, []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if begun and own == now:
                    state.update(b"\n")
                else:
                    if begun:
                        done.append((now, state.hexdigest()))
                    now, state, begun = own, hashlib.sha256(), True
                state.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], [key, digest])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], [key, digest])

    kind = arranged.schema["key"].dataType.simpleString()
    return arranged.mapInArrow(run, f"`{key}` {kind}, `{digest}` string")
