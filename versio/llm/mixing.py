"""Mixing sources to target weights by Poisson replication.

A source with n_s documents and target share w_s of ``total`` rows has the mean
repetition rate r_s = w_s * total / n_s. Every document gets a uniform number
from a hash of its id and the seed, the Poisson distribution with mean r_s is
inverted there, and the document is repeated that many times. Counts depend on
id and seed only, so a lost task is recomputed alike. The copies are then put
into one global random order: the order of a hash of id and copy.

A rate above ``PIECE_RATE`` is a sum of independent Poisson numbers of equal
smaller rates, each inverted at its own uniform number, so that no probability
underflows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import fresh, join_keys, written

#: Largest rate that is inverted in one piece.
PIECE_RATE = 16.0
#: Terms of the distribution that are summed: beyond, a piece's tail is under 2^-53.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the SHA-256 of the parts joined by ':'."""
    digest = F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str | None, float] | None = None, *, power: float = 0.5, total: float | None = None) -> DataFrame:
    """One row for each source (null is a source of its own): ``source``, ``n``, ``target`` (share of
    the mixture) and ``rate``.

    ``weights`` gives sources relative target weights; a source without one gets 0. Without ``weights``
    a source's weight is its number of documents to the ``power``. ``total`` is the expected size of the
    mixture (default: the number of documents). Counts cover all documents.
    """
    counts = written(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
        counts = counts.withColumn("weight", weight)
    all_weights, all_rows = counts.agg(F.sum("weight"), F.sum("n")).first()  # one row of two numbers
    size = float(total) if total is not None else float(all_rows or 0)
    target = F.col("weight") / F.lit(all_weights) if all_weights else F.lit(0.0)
    counts = counts.withColumn("target", target)
    return counts.select("source", "n", "target", (F.col("target") * F.lit(size) / F.col("n")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """The first TERMS values of the cumulative distribution for a rate of at most PIECE_RATE."""
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), first, step)["c"]


def replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", power: float = 0.5, total: float | None = None, seed: int = 42, partitions: int | None = None, copy_col: str = "copy", order_col: str = "shuffle_key") -> DataFrame:
    """``docs`` with every row repeated by its Poisson count, in a global random order.

    Adds ``copy_col`` (1 up to the count) and ``order_col`` (16 hex digits; partitions and rows within
    them are in its order); columns of ``docs`` that are so named are replaced. A null source is a source
    of its own. A null id counts as the text 'null', so that all rows without one share a count; rows
    that repeat an id share it too. A rate of 0 repeats no row. An empty table gives no rows. Texts are
    carried whole whatever their length; other columns are kept as they are.
    """
    names = [c for c in docs.columns if c.lower() not in (copy_col.lower(), order_col.lower())]
    rates = source_rates(docs, source_col, weights, power=power, total=total)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE_RATE)).cast("int")
    table = rates.select("source", pieces.alias("pieces"), (F.col("rate") / pieces).alias("part"))
    key, many, cdf = (fresh(names, f"_{x}") for x in ("source_key", "pieces", "cdf"))
    table = table.select(F.col("source").alias(key), F.col("pieces").alias(many), poisson_cdf(F.col("part")).alias(cdf))
    id_, source = F.col(id_col), F.col(source_col)
    rows = join_keys(docs.select(*names).withColumn(key, source), table, [key], salt_by=F.xxhash64(id_), how="inner")
    drawn = F.transform(F.sequence(F.lit(1), F.col(many)), lambda k: F.size(F.filter(F.col(cdf), lambda c: c < uniform(F.lit(seed), id_, k))))
    count = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn(many, count).where(F.col(many) > 0)
    rows = rows.select(*names, F.explode(F.sequence(F.lit(1), F.col(many))).alias(copy_col))
    order = F.substring(F.sha2(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null")), F.col(copy_col)), 256), 1, 16)
    rows = rows.withColumn(order_col, order)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash is uniform, so its leading digits give equal shares without a sampling pass
    share = F.floor(F.conv(F.substring(order_col, 1, 8), 16, 10).cast("bigint") * n / F.lit(float(1 << 32))).cast("int")
    return rows.repartitionById(n, share).sortWithinPartitions(order_col, id_col)
