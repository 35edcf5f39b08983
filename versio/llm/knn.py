"""Exact top-k search by inner product, as a Voronoi kNN join (Lu et al., 2012).

Inner products become distances: with M the largest norm, a candidate x gets
one more component sqrt(M^2 - |x|^2) and a query q gets 0, so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest candidates are those with the
largest products. Then:

1. Pivots are the means of clusters of a bounded sample; their number grows with
   the table up to a limit. Candidates and queries are grouped by their nearest
   pivot.
2. Summaries: for each pivot the queries' number and largest distance U, and
   the k + 1 smallest distances of candidates. For a pivot i with queries, the
   (k + 1)-th smallest of U_i + |p_i p_j| + d over all summarised candidates is
   a distance within which every query of i has its k neighbours (one of the
   k + 1 may be the query itself).
3. That bound is sharpened: each query is compared with a bounded number of
   candidates of its own pivot, and the k-th best of these is at least as far as
   the true one. theta_i is the largest such distance of the queries of i.
4. A candidate is needed by the queries of i only if its distance from p_i is at
   most U_i + theta_i: a farther one is beyond theta_i of all of them.
5. Pivots with few queries are packed into blocks with their nearest neighbours, as
   these need much the same candidates; a pivot with many queries has blocks of its
   own. A candidate is replicated once to each block that holds a pivot in need of
   it, and a block's candidates are dealt into parts of bounded size. Each block and
   part is solved locally, and the best of the parts are merged.

The bounds use floating point and are widened by a margin; products are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versio.llm.common import written

#: Rows per pivot, about; pivots at least and at most (the summaries sent to the driver have pivots * (k + 1) rows).
CELL_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 500, 8, 1024
#: Rows of the sample that the pivots are fitted on, per pivot.
SAMPLE = 16
#: Queries and candidates in a block, about.
QUERY_BLOCK, DATA_BLOCK = 1024, 8192
#: Numbers in a part of a matrix of distances.
PART = 1 << 22


def quantised(table: DataFrame, id_col: str, vector_col: str, scale: float, is_query: Column) -> DataFrame:
    """``id``, ``query``, ``vec`` (floor(scale * x), whole numbers as doubles), ``norm2`` and ``largest`` (of the
    components' sizes), without unusable rows."""
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector_col).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vecs, norms, sizes = [], [], [], []
            for k, v in enumerate(batch.column(2)):
                if v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0  # one zero
                if np.isfinite(x).all():
                    keep.append(k)
                    vecs.append(x.astype("<f8").tobytes())
                    norms.append(float(x @ x))
                    sizes.append(float(np.abs(x).max(initial=0.0)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64()), pa.array(sizes, pa.float64())], ["id", "query", "vec", "norm2", "largest"])

    return rows.mapInArrow(run, "id bigint, query boolean, vec binary, norm2 double, largest double")


def matrix(vecs: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Rows of whole numbers as doubles, shorter ones padded with zeros."""
    out = np.zeros((len(vecs), dims))
    for k, v in enumerate(vecs):
        x = np.frombuffer(v.as_py(), kind)
        out[k, :len(x)] = x
    return out


def means(x: np.ndarray, number: int, rounds: int = 8) -> np.ndarray:
    """At most ``number`` means of clusters of the rows of ``x`` (Lloyd's iteration from spread-out rows)."""
    rng = np.random.default_rng(0)
    x = np.unique(x, axis=0)
    if len(x) <= number:
        return x
    centres, near = x[[0]], ((x - x[0]) ** 2).sum(1)
    while len(centres) < number and near.max() > 0:  # rows far from all centres so far, a few at a time
        more = x[np.unique(rng.choice(len(x), min(number - len(centres), 1 + len(centres)), p=near / near.sum()))]
        centres = np.vstack([centres, more])
        for m in more:
            near = np.minimum(near, ((x - m) ** 2).sum(1))
    for _ in range(rounds):
        cell = np.argmin((centres * centres).sum(1)[None] - 2 * x @ centres.T, 1)
        count = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres = total[count > 0] / count[count > 0][:, None]
    return centres


@dataclass
class Pivots:
    """Points in the extended space, and M^2."""

    points: np.ndarray
    top: float

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        added = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.hstack([x, added[:, None]])

    def distances(self, y: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of extended rows to points, each within ``margin``."""
        return np.sqrt(np.maximum((y * y).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * y @ points.T, 0))

    @property
    def margin(self) -> float:
        """What rounding adds to a distance, at most."""
        return 1e-6 * (1 + float(np.sqrt(self.top)))

    def nearest(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.extended(x, query), self.points)
        cell = np.argmin(d, 1)
        return cell, d[np.arange(len(d)), cell]


@dataclass
class Groups:
    """The pivots with queries: their numbers, U, theta, and the block of each; for each block into how many its
    queries (``salts``) and candidates (``parts``) are dealt. Pivots are in order of their blocks."""

    cells: np.ndarray
    reach: np.ndarray
    theta: np.ndarray
    block: np.ndarray
    salts: np.ndarray
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    needed: int = 0
    replicated: int = 0

    def need(self, pivots: Pivots, x: np.ndarray) -> np.ndarray:
        """Rows x pivots: whether the candidate may be among the k best of one of the pivot's queries."""
        d = pivots.distances(pivots.extended(x, False), pivots.points[self.cells])
        return d <= (self.reach + self.theta)[None] * (1 + 1e-9) + 4 * pivots.margin

    def by_block(self, need: np.ndarray) -> np.ndarray:
        """Rows x blocks: whether one of the block's pivots needs the candidate."""
        return np.logical_or.reduceat(need, np.searchsorted(self.block, np.arange(len(self.salts))), axis=1)

    def share(self, rows: int) -> float:
        """Share of all pairs of a candidate and a pivot with queries in which the candidate is needed."""
        return self.needed / (rows * len(self.cells)) if rows and len(self.cells) else 0.0


def packed(points: np.ndarray, sizes: np.ndarray, block: int) -> list[list[int]]:
    """Places of pivots by block: from the first one left, its nearest ones as long as there is room."""
    left, out = list(range(len(points))), []
    while left:
        own = [left.pop(0)]
        room = block - sizes[own[0]]
        while left and room > 0:
            d = ((points[left] - points[own].mean(0)) ** 2).sum(1)
            k = int(np.argmin(d))
            if sizes[left[k]] > room:
                break
            room -= sizes[left[k]]
            own.append(left.pop(k))
        out.append(own)
    return out


def summary_bounds(pivots: Pivots, k: int, queries: dict[int, tuple[int, float]], nearest: list[tuple[int, float]], block: int) -> Groups:
    """Groups with the bounds that the summaries give: ``queries`` maps a pivot to its number of queries and U;
    ``nearest`` lists the smallest distances of the candidates of each pivot."""
    cells = np.array(sorted(queries), np.int64)
    sizes = np.array([queries[c][0] for c in cells.tolist()], np.int64)
    blocks = packed(pivots.points[cells], sizes, block)
    cells = cells[[g for own in blocks for g in own]] if len(cells) else cells
    reach = np.array([queries[c][1] for c in cells.tolist()])
    near, d = np.array([c for c, _ in nearest], np.int64), np.array([x for _, x in nearest])
    theta = np.full(len(cells), np.inf)
    if len(d) > k:
        for n, c in enumerate(cells.tolist()):
            apart = pivots.distances(pivots.points[[c]], pivots.points)[0]
            theta[n] = np.partition(reach[n] + apart[near] + d, k)[k] + 3 * pivots.margin
    of = np.repeat(np.arange(len(blocks)), [len(own) for own in blocks])
    return Groups(cells, reach, theta, of, np.array([max(1, -(-int(sizes[own].sum()) // block)) for own in blocks], np.int64))


def _top(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids ascending on a tie) of candidates sorted by id, without the query's own row."""
    other = ids != own
    scores, ids = (scores, ids) if other.all() else (scores[other], ids[other])
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))
    return ids[order], scores[order]


def exact_numbers(x: np.ndarray, top: float) -> np.ndarray:
    """Whole numbers in a type whose products are exact when no squared norm is over ``top``: doubles, longs, or
    Python's integers."""
    if top < 2**53:
        return x
    if top < 2**62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


@dataclass
class Join:
    """What is set up before the join: the placed rows, the pivots, the groups."""

    placed: DataFrame
    pivots: Pivots
    groups: Groups
    rows: int
    dims: int
    kind: str


def plan(table: DataFrame, id_col: str, vector_col: str, k: int, is_query: Column, *, scale: float = 64.0, pivots: int | None = None, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> Join:
    """Steps 1 to 4: rows grouped by pivots, bounds, and the number of candidates that each group needs."""
    rows = written(quantised(table, id_col, vector_col, scale, is_query).distinct(), "vectors")
    n, top, width, largest = rows.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.octet_length("vec")), F.max("largest")).first()
    dims, top = (width or 0) // 8, top or 0.0
    kind = "<i4" if (largest or 0.0) < 2**31 else "<f8"
    number = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-n // CELL_ROWS)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * number).select("vec").collect()  # at most SAMPLE * MOST_PIVOTS rows
    sample = np.array([np.pad(x := np.frombuffer(r.vec, "<f8"), (0, dims - len(x))) for r in drawn], np.float64).reshape(len(drawn), dims)
    centre = Pivots(np.zeros((0, dims + 1)), top)
    centre.points = means(centre.extended(sample, False), number)
    size = max(1, PART // max(len(centre.points), 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                x, query = matrix(batch.column(2), dims, "<f8"), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                cell, d = centre.nearest(x, False)
                own, far = np.zeros(len(x), np.int32), np.zeros(len(x))
                if query.any():
                    own[query], far[query] = centre.nearest(x[query], True)
                vecs = batch.column(2) if kind == "<f8" else pa.array([np.frombuffer(v.as_py(), "<f8").astype(kind).tobytes() for v in batch.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vecs, pa.array(cell.astype(np.int32)), pa.array(d), pa.array(own), pa.array(far)], ["id", "query", "vec", "cell", "d", "query_cell", "far"])

    placed = written(rows.select("id", "query", "vec").mapInArrow(assign, "id bigint, query boolean, vec binary, cell int, d double, query_cell int, far double"), "placed")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                best[c] = np.sort(np.append(best.get(c, np.zeros(0)), d[cell == c]))[:k + 1]
        cells = np.repeat(list(best), [len(v) for v in best.values()]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.concatenate([np.zeros(0), *best.values()]))], ["cell", "d"])

    by_cell = Window.partitionBy("cell").orderBy("d")
    nearest = placed.select("cell", "d").mapInArrow(smallest, "cell int, d double").withColumn("n", F.row_number().over(by_cell)).where(F.col("n") <= k + 1).select("cell", "d").collect()
    asked = placed.where("query").groupBy("query_cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    groups = summary_bounds(centre, k, {r.query_cell: (r.n, r.far) for r in asked}, [(r.cell, r.d) for r in nearest], query_block)
    join = Join(placed, centre, groups, n, dims, kind)
    if len(groups.cells):
        _sharpen(join, k, data_block)
        _count_needed(join, data_block)
    return join


def _salt(seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)).cast("int")


def _sharpen(join: Join, k: int, data_block: int) -> None:
    """theta from the queries' k-th best among at most about ``data_block`` candidates of their own pivot."""
    groups, pivots, dims, kind = join.groups, join.pivots, join.dims, join.kind
    sizes = {r.cell: r["count"] for r in join.placed.groupBy("cell").count().collect()}  # a row a pivot
    place = {c: g for g, c in enumerate(groups.cells.tolist())}
    shares = [(c, min(1.0, data_block / sizes[c]), int(groups.salts[groups.block[g]])) for c, g in place.items() if sizes.get(c)]
    table = join.placed.sparkSession.createDataFrame(shares or [(-1, 0.0, 1)], "cell int, share double, salts int")  # a row a pivot
    key = [F.col("cell"), F.col("salt")]
    asking = join.placed.where("query").select(F.col("query_cell").alias("cell"), "id", "vec", _salt(0).alias("draw"))
    left = asking.join(F.broadcast(table), "cell").select(
        "cell", F.pmod("draw", "salts").alias("salt"), F.col("id").alias("id"), F.col("vec").alias("vec"))
    some = join.placed.select("cell", "id", "vec", _salt(2).alias("draw")).join(F.broadcast(table), "cell").where(F.col("draw") < F.col("share") * (1 << 20))
    right = some.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "id", "vec")

    def kth(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.int64())], ["cell", "theta", "queries"])
        worst, ids = 0.0, data.column("id").to_numpy()
        x, q = matrix(data.column("vec"), dims, kind), matrix(queries.column("vec"), dims, kind)
        for own, row in zip(queries.column("id").to_pylist(), q, strict=True):
            scores = (x @ row)[ids != own]
            if len(scores) < k:
                worst = np.inf
                break
            best = np.partition(scores, len(scores) - k)[len(scores) - k]
            worst = max(worst, float(row @ row) + pivots.top - 2 * best)
        return pa.table([pa.array([queries.column("cell")[0].as_py()], pa.int32()), pa.array([float(np.sqrt(max(worst, 0.0)))]), pa.array([queries.num_rows], pa.int64())], ["cell", "theta", "queries"])

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(kth, "cell int, theta double, queries bigint")
    for r in found.groupBy("cell").agg(F.max("theta").alias("theta")).collect():  # a row a pivot
        g = place[r.cell]
        groups.theta[g] = min(groups.theta[g], r.theta + 3 * pivots.margin)


def _count_needed(join: Join, data_block: int) -> None:
    """How many candidates each block needs, and so how many parts they are dealt into."""
    groups, pivots, dims, kind = join.groups, join.pivots, join.dims, join.kind
    size, blocks = max(1, PART // len(groups.cells)), len(groups.salts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks + 1, np.int64)  # the last one: pairs with pivots
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                need = groups.need(pivots, matrix(batch.column(0).slice(at, size), dims, kind))
                total[:-1] += groups.by_block(need).sum(0)
                total[-1] += need.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["block", "n"])

    found = {r.block: r.n for r in join.placed.select("vec").mapInArrow(count, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect()}
    total = np.array([found.get(b, 0) for b in range(blocks)], np.int64)
    groups.parts, groups.needed, groups.replicated = np.maximum(1, -(-total // data_block)), found.get(blocks, 0), int(total.sum())


def top_k(table: DataFrame, id_col: str, vector_col: str, k: int, is_query: Column, *, scale: float = 64.0, pivots: int | None = None, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """For each query its ``k`` candidates with the largest inner product: ``query_id``, ``rank`` (from 1),
    the id column and ``score``; ties go to the smaller id, and fewer candidates give fewer rows.

    Vectors are turned into floor(scale * x). Queries are the rows with ``is_query`` true (null: false),
    candidates all rows but those with the query's id. A null id, a null vector, or one with a null or
    non-finite component takes no part. Finite components may be of any size: a score among the k best that is no
    64-bit integer is an error. A shorter vector counts as filled up with zeros. Rows that repeat an id and a
    vector count once. An empty table, or one without queries, gives no rows; other columns are not read.
    """
    join = plan(table, id_col, vector_col, k, is_query, scale=scale, pivots=pivots, query_block=query_block, data_block=data_block)
    return _solved(join, k, id_col)


def _each(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place ``times`` times, and the number of each repetition from 0."""
    which = np.repeat(np.arange(len(times)), times)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)


def _dealt(batch: pa.RecordBatch, which: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
    at = pa.array(which)
    return pa.RecordBatch.from_arrays([*(pa.array(n.astype(np.int32)) for n in numbers), batch.column(0).take(at), batch.column(1).take(at)], ["block", "salt", "part", "id", "vec"])


def _solved(join: Join, k: int, id_col: str) -> DataFrame:
    """Step 5."""
    groups, centre, dims, kind, placed = join.groups, join.pivots, join.dims, join.kind, join.placed
    place = {c: g for g, c in enumerate(groups.cells.tolist())}
    top = centre.top
    size = max(1, PART // max(len(groups.cells), 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = groups.block[np.array([place[c] for c in batch.column(2).to_pylist()], np.int64)]
            salt = batch.column(3).to_numpy() % groups.salts[own]
            which, part = _each(groups.parts[own])
            yield _dealt(batch, which, own[which], salt[which], part)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                row, block = np.nonzero(groups.by_block(groups.need(centre, matrix(batch.column(1), dims, kind))))
                part = batch.column(2).to_numpy()[row] % groups.parts[block]
                which, salt = _each(groups.salts[block])
                yield _dealt(batch, row[which], block[which], salt, part[which])

    key = "block int, salt int, part int, id bigint, vec binary"
    left = placed.where("query").select("id", "vec", "query_cell", _salt(0).alias("draw")).mapInArrow(ask, key)
    right = placed.select("id", "vec", _salt(1).alias("draw")).mapInArrow(replicate, key)

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and data.num_rows:
            ids = data.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], exact_numbers(matrix(data.column("vec"), dims, kind)[order], top)
            asked_ids = queries.column("id").to_numpy()
            q = exact_numbers(matrix(queries.column("vec"), dims, kind), top)
            for at in range(0, len(q), 128):
                for own, scores in zip(asked_ids[at:at + 128].tolist(), q[at:at + 128] @ x.T, strict=True):
                    best, score = _top(scores, ids, own, k)
                    if score.dtype == object and any(abs(s) >= 2**63 for s in score.tolist()):
                        raise OverflowError("a score is no 64-bit integer")
                    out.append((np.full(len(best), own), best, score))
        cols = [np.concatenate([np.zeros(0, np.int64), *(o[c].astype(np.int64) for o in out)]) for c in range(3)]
        return pa.table(cols, ["query_id", "vec_id", "score"])

    block = ("block", "salt", "part")
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
