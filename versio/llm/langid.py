"""Language identification by hierarchical discrimination.

A softmax model names the family of a text's language; within a family, linear
support vector machines for every pair of its languages vote. Both see the
frequencies of single bytes and hashed pairs and triples of bytes of the
lower-case letters, over the whole text.

The models are fitted on at most ``per_lang`` rows of each of the ``max_langs``
most frequent languages (those with the smallest hash of id and text), so that a
rare language is learned too and what the driver gets is bounded. Both bounds
concern labelled rows alone; every language's count covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versio.llm.common import fresh, written
from versio.llm.linear import fit_softmax, fit_svm, sigmoid

#: Language families by ISO 639-1 code; a language without one is a family of its own.
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "is", "af"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl"], "romance"),
    **dict.fromkeys(["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"], "slavic"),
}
#: Rows of each language that the models are fitted on, at most.
PER_LANG = 500
#: Languages that the models can tell apart, at most (the most frequent ones).
MAX_LANGS = 200
DIMS = 4096
#: Characters of a text that are counted at a time.
PIECE = 1 << 20
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def profile(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram frequencies of a text, of length 1; None for a text without letters."""
    counts, some = np.zeros(DIMS), False
    for at in range(0, len(text or ""), PIECE):
        plain = " " + _NO_LETTER.sub(" ", text[at:at + PIECE].lower()).strip() + " "
        if not some and not any(map(str.isalpha, plain)):
            continue
        some = True
        b = np.frombuffer(plain.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        pairs = b[:-1] * np.uint32(257) + b[1:]
        triples = pairs[:-1] * np.uint32(263) + b[2:] + np.uint32(1 << 20)
        hashed = (np.concatenate([pairs, triples]) * np.uint32(2654435761)) >> np.uint32(16)
        counts += np.bincount(b, minlength=DIMS) + np.bincount(256 + hashed % np.uint32(DIMS - 256), minlength=DIMS)
    return np.sqrt(counts / counts.sum()).astype(np.float32) if some else None


@dataclass
class Hierarchy:
    """Families with their languages, the weights of the families, and those of each pair of a family."""

    families: list[list[str]]
    weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, np.float32(1))
        z = self.weights @ x
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        langs, sure = self.families[k], float(p[k] / p.sum())
        if len(langs) == 1:
            return langs[0], sure
        votes = {a: [0, 0.0] for a in langs}
        won: dict[str, list[float]] = {a: [] for a in langs}
        for (a, b), w in ((k, w) for k, w in self.pairs.items() if k[0] in votes and k[1] in votes):
            margin = float(w @ x)
            first = a if margin >= 0 else b
            votes[first][0] += 1
            votes[a][1] += margin
            votes[b][1] -= margin
            won[a].append(margin)
            won[b].append(-margin)
        best = max(langs, key=lambda a: (*votes[a], a))
        return best, sure * float(np.mean(sigmoid(2 * np.array(won[best]))))


def fit_hierarchy(xs: np.ndarray, langs: list[str], families: Mapping[str, str] = FAMILIES) -> Hierarchy:
    """Fit families and pairs on profiles."""
    by_family: dict[str, list[str]] = {}
    for a in sorted(set(langs)):
        by_family.setdefault(families.get(a, f"only {a}"), []).append(a)
    groups = [by_family[f] for f in sorted(by_family)]
    of = {a: k for k, group in enumerate(groups) for a in group}
    weights = fit_softmax(xs, np.array([of[a] for a in langs]), len(groups), rounds=400)
    pairs, named = {}, np.array(langs, object)
    for a, b in (p for group in groups for p in combinations(group, 2)):
        use = (named == a) | (named == b)
        pairs[a, b] = fit_svm(xs[use], np.where(named[use] == a, 1.0, -1.0)).astype(np.float32)
    return Hierarchy(groups, weights, pairs)


def training_rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, max_langs: int) -> DataFrame:
    """(draw, lang, text): at most ``per_lang`` rows with letters of each of the ``max_langs`` most frequent
    languages. A row is drawn by the hash of its id and text, so rows that share an id are drawn apart; rows that
    repeat both count once."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs)  # bounded
    # a language's share is drawn by its count, with a margin; of these the smallest draws stay
    share = F.least(F.lit(1.0), (1.5 * per_lang + 20) / F.col("n"))
    place = F.pmod("draw", F.lit(1 << 30))
    few = rows.join(F.broadcast(langs), "lang").where(place < share * (1 << 30)).select("lang", "text", place.alias("draw"), F.xxhash64("text").alias("mark"))
    # a text that is there very often shares a draw with its copies: pre-aggregated before the ranking
    few = few.groupBy("lang", "draw", "mark").agg(F.min("text").alias("text"))
    smallest = Window.partitionBy("lang").orderBy("draw", "mark")
    return few.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= per_lang).select("draw", "lang", "text")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, families: Mapping[str, str] = FAMILIES) -> Hierarchy | None:
    """Fit on a sample of ``labelled``; rows without a language or without letters teach nothing. None if no
    row does."""
    drawn = written(training_rows(labelled, id_col, text_col, lang_col, per_lang, max_langs), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, a, x.tobytes()) for d, a, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (x := profile(t)) is not None]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["draw", "lang", "x"])

    kept = drawn.mapInArrow(run, "draw bigint, lang string, x binary").collect()  # at most per_lang * max_langs rows
    kept.sort(key=lambda r: (r.draw, r.lang, bytes(r.x)))
    if not kept:
        return None
    return fit_hierarchy(np.stack([np.frombuffer(r.x, np.float32) for r in kept]), [r.lang for r in kept], families)


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: the id, the columns ``keep``, ``lang_pred`` and ``score`` (0 to 1:
    the family's probability times the mean certainty of the pairs that the language is in).

    Only the text is read, whole. A null text or one without a letter is ``und`` with score 0, and so is
    every text if no model could be trained. Repeated rows get equal answers; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias(fresh([id_col, *keep], "_text")))
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.families, model.weights, model.pairs))  # DIMS numbers for each family and pair
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value and Hierarchy(*shared.value)
        for batch in batches:
            found = []
            for t in batch.column(n):
                x = profile(t.as_py())
                found.append((UNKNOWN, 0.0) if x is None or fitted is None else fitted.predict(x))
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{head}, lang_pred string, score double")


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves remainder 0."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(folds)) == 0
