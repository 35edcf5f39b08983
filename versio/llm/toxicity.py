"""Toxicity by a classifier chain.

Categories are predicted one after the other. The linear model of a category
sees which words a text has, and the probabilities of the categories before it
in the chain. For training, these probabilities come from models that have not
seen the row (out-of-fold); for prediction, from the models fitted on the whole
sample.

Features are the words of a text, their first four and first five characters
(inflected forms share them), and runs of punctuation. Only features that a
category uses significantly often or seldom are kept, at most ``max_features``.
The models are fitted on at most ``sample_rows`` labelled rows (those with the
smallest hash of their id, one row of each id); feature counts are taken on that
sample by Spark, and all documents are scored, whole, where they lie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import fresh, written
from versio.llm.linear import fit_logistic, sigmoid

_WORD = re.compile(r"\w+|[^\w\s]{2,}")
#: Characters of a text whose words are found at a time; a piece ends at white space.
PIECE = 1 << 20
_SPACE = re.compile(r"\s")

#: Rows that the models are fitted on, at most.
SAMPLE_ROWS = 8000
#: Features that the models use, at most.
MAX_FEATURES = 6000
FOLDS = 4
#: Probability over which a text is toxic.
THRESHOLD = 0.4
#: Weight of the squared coefficients in the loss.
L2 = 1e-4


def features(text: str) -> set[str]:
    """The features of a text: its lower-case words, '4:' and '5:' with their beginnings, runs of marks."""
    words: set[str] = set()
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words.update(_WORD.findall(text[at:end].lower()))
        at = end
    words.update([f"{n}:{w[:n]}" for n in (4, 5) for w in words if len(w) > n])
    return words


@dataclass
class Chain:
    """A fitted chain: feature places, and for each category its weights, chain weights and intercept."""

    categories: tuple[str, ...]
    places: dict[str, int]
    models: list[tuple[np.ndarray, np.ndarray, float]]

    def probabilities(self, text: str | None) -> list[float]:
        get = self.places.get
        found = [p for f in features(text or "") if (p := get(f)) is not None]
        logits: list[float] = []
        for w, v, b in self.models:
            logits.append(min(MOST, max(-MOST, float(w[found].sum() + v @ np.array(logits) + b))))
        return [1 / (1 + math.exp(-z)) for z in logits]


#: Logits are held within this on both sides, in training as in scoring, so a very long text gives a later model
#: nothing that it was not fitted on.
MOST = math.log((1 - 1e-6) / 1e-6)


def _logit(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.log(p) - np.log1p(-p), -MOST, MOST)


def fit_rows(places: Sequence[Sequence[int]], labels: np.ndarray, dims: int, folds: int = FOLDS) -> tuple[list[tuple], np.ndarray]:
    """Models of the chain and the out-of-fold probabilities (rows x categories) they were trained with."""
    n = len(places)
    rows = np.repeat(np.arange(n), [len(p) for p in places])
    cols = np.array([c for p in places for c in p], np.int64)
    before, models, held_out = np.zeros((n, 0)), [], []
    fold = np.random.default_rng(0).permutation(n) % folds  # whatever order the rows come in
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_logistic(rows, cols, before, y, dims, l2=L2))
        p = np.zeros(n)
        for f in range(folds):
            fit, test = fold != f, fold == f
            where, seen = np.cumsum(fit) - 1, fit[rows]
            w, v, b = fit_logistic(where[rows[seen]], cols[seen], before[fit], y[fit], dims, l2=L2)
            z = np.bincount(rows, w[cols], n) + before @ v + b
            p[test] = sigmoid(z[test])
        held_out.append(p)
        before = np.hstack([before, _logit(p)[:, None]])
    return models, np.stack(held_out, 1) if held_out else np.zeros((n, 0))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, least_rows: int = 3, least_share: float = 0.001, least_z: float = 4.0) -> Chain:
    """Fit the chain in the order of ``categories``, which maps names to boolean columns of ``labels``.

    A row counts as labelled if every category is known; labels that repeat an id count once, true if one
    of them is. A feature needs ``least_rows`` sample rows and ``least_share`` of them, and a count that is
    ``least_z`` standard deviations from what is expected in a category. Without labelled rows every probability
    is that of the constant model.
    """
    names = list(categories)
    known = [F.max(c).alias(f"y{k}") for k, c in enumerate(categories.values())]
    given = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*known).dropna()
    sample = written(given.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows), "sample")  # at most sample_rows, so it may be broadcast
    ys = [F.col(f"y{k}").cast("int").alias(f"y{k}") for k in range(len(names))]
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id")
    # one row for each sampled id (that with the smallest text hash), so the sample is bounded in rows; copies and
    # repeats of an id are pre-aggregated
    one = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("row")
    texts = found.groupBy("_id", F.array(*ys).alias("ys")).agg(one).select("_id", "ys", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t.as_py() or "")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "ys", "found"])

    kind = texts.schema["_id"].dataType.simpleString()
    seen = written(texts.mapInArrow(run, f"id {kind}, ys array<int>, found array<string>"), "features")
    total, *yes = seen.agg(F.count(F.lit(1)), *[F.sum(F.col("ys")[k]) for k in range(len(names))]).first()
    counts = seen.select("ys", F.explode("found").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("ys")[k]).alias(f"y{k}") for k in range(len(names))])
    z = [F.abs(F.col(f"y{k}") - F.col("n") * (p := (yes[k] or 0) / max(total, 1))) / F.sqrt(F.col("n") * max(p * (1 - p), 1e-9)) for k in range(len(names))]
    far = F.greatest(*z, F.lit(0.0)) if z else F.lit(0.0)
    kept = counts.where((F.col("n") >= max(least_rows, least_share * total)) & (far >= least_z)).orderBy(far.desc(), "feature").limit(max_features).select("feature").collect()  # bounded
    places = {f: k for k, f in enumerate(sorted(r.feature for r in kept))}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[p for f in row.as_py() if (p := places.get(f)) is not None] for row in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "ys", "places"])

    rows = seen.mapInArrow(place, f"id {kind}, ys array<int>, places array<int>").collect()  # at most sample_rows
    rows.sort(key=lambda r: (r.id, r.places))
    models, _ = fit_rows([r.places for r in rows], np.array([r.ys for r in rows]).reshape(len(rows), len(names)), len(places))
    return Chain(tuple(names), places, models)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", *, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row of ``docs``: the id, the columns ``keep``, and ``p_<category>`` for each category."""
    extra = [F.col(c) for c in keep]
    rows = docs.select(F.col(id_col), *extra, F.col(text_col).cast("string").alias(fresh(keep, "_text")))
    shared = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.places, chain.models))  # bounded by MAX_FEATURES
    n, names = 1 + len(extra), [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        for batch in batches:
            p = np.array([model.probabilities(t.as_py()) for t in batch.column(n)], float).reshape(batch.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(p[:, k]) for k in range(len(names)))], [*batch.schema.names[:n], *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, ", ".join([head, *(f"{x} double" for x in names)]))


#: The categories that the table ``labels`` tells, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, categories: Mapping[str, str] = CATEGORIES, threshold: float = THRESHOLD, **fit: object) -> DataFrame:
    """One row for each row of ``docs``: the id, ``p_<category>`` for each category of the chain, and
    ``toxic``: whether the last category's probability is over ``threshold``.

    A null text counts as empty; a text without a feature that the models use gets their constant. Texts
    are read whole. Rows with null ids are scored but never trained on; repeated rows are scored alike.
    Empty documents give no rows; without labels nothing is toxic. Other columns are not read.
    """
    chain = fit_chain(docs, labels, {k: F.expr(c) for k, c in categories.items()}, id_col, text_col, **fit)
    return score(docs, chain, id_col, text_col).withColumn("toxic", F.col(f"p_{chain.categories[-1]}") > threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, categories: Mapping[str, str] = CATEGORIES, threshold: float = THRESHOLD, **fit: object) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` does not reject, with all their columns, scored in place."""
    chain = fit_chain(docs, labels, {k: F.expr(c) for k, c in categories.items()}, id_col, text_col, **fit)
    shared = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.places, chain.models))

    @F.pandas_udf("double")
    def last(texts: pd.Series) -> pd.Series:
        model = Chain(*shared.value)
        return pd.Series([model.probabilities(t)[-1] for t in texts], dtype=float)

    return docs.where(last(F.col(text_col).cast("string")) <= threshold)
