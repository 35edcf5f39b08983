"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical without white space. Rows are grouped
three times, each time only among those that still share a group: by length,
by the hash of a prefix, by the hash of the whole text. What survives a level
is told to the next scan by a table of fixed size (``SLOTS`` words of 64 bits,
one bit a group, placed by hash), which is small enough to broadcast at any
input size. A group whose bit is set by another one is merely looked at again;
the last grouping is by length and full hash, so it decides alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import fresh, join_keys, unsent, written

#: The white space that equality ignores: space and \t, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Words of 64 bits in a survivor table: at most this many rows are broadcast.
SLOTS = 1 << 16
#: Characters of the text that the second level hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _survivors(rows: DataFrame, keys: list[str], hashed: str) -> DataFrame:
    """The bits of the groups of ``keys`` with more than one row, as at most SLOTS rows (slot, bits)."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64(*keys).alias(hashed))
    slot, bit = F.col(hashed).bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(F.col(hashed), 58)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
    return written(groups.groupBy(slot.alias("slot")).agg(F.bit_or(one).alias("bits")), "survivors")


def _flagged(rows: DataFrame, keys: list[str], survivors: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column ``name``: false if no group of ``keys`` that survived has their hash."""
    slot = F.xxhash64(*keys).bitwiseAND(F.lit(SLOTS - 1))
    bit = F.shiftrightunsigned(F.xxhash64(*keys), 58).cast("int")
    joined = rows.join(F.broadcast(survivors), slot == F.col("slot"), "left")
    held = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("bigint")), bit).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(name, held).drop("slot", "bits")


def refine(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``texts`` (columns ``keys`` and ``norm``) with ``len``, and with ``full``, the SHA-256 of the
    whole text where another row may have the same text, else null."""
    sized = texts.withColumn("len", F.length("norm"))
    by_length = _survivors(sized, ["len"], "h")
    started = _flagged(sized, ["len"], by_length, "second")
    started = started.withColumn("prefix", F.when(F.col("second"), F.xxhash64(F.substring("norm", 1, PREFIX))))
    by_prefix = _survivors(started.where("second"), ["len", "prefix"], "h")
    hashed = _flagged(started, ["len", "prefix"], by_prefix, "third")
    full = F.when(F.col("second") & F.col("third"), F.sha2("norm", 256))
    return hashed.withColumn("full", full).select(*keys, "len", "full")


def _decided(told: DataFrame, several: str, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each id and distinct text of ``told`` (rows with the flag ``several``): ``id``, ``many`` (the flag),
    ``mark`` (tells apart the texts of an id), ``points``, ``full``, ``n`` (rows that are alike), ``keep``, ``size``,
    ``first`` and a struct ``carried``."""
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0))
    norm = normalised(F.col(text_col))
    texts = told.select(F.col(id_col).alias("id"), F.col(several).alias("many"), _mark(norm, several).alias("mark"), F.length(F.coalesce(text_col, F.lit(""))).alias("points"),
                        norm.alias("norm"), carried.alias("carried"))
    keys = ["id", "many", "mark", "points", "carried"]
    rows = refine(texts, keys).groupBy(*keys, "len", "full").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "refined")
    alone, shared = rows.where("full is null"), rows.where("full is not null")
    order = F.struct((-F.col("points")).alias("back"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("keep"))
    groups = shared.groupBy("len", "full").agg(F.min(order).alias("best"), F.sum("n").alias("size"))
    groups = groups.select("len", "full", "best.back", "best.keep", "size")
    first = (-F.col("points") == F.col("back")) & F.col("id").eqNullSafe(F.col("keep"))
    # a group of copies may hold a third of all rows: its rows are dealt out, or its few numbers broadcast
    grouped = join_keys(shared, groups, ["len", "full"], salt_by=F.xxhash64("id", "mark"), how="inner").withColumn("first", first)
    names = [*keys, "full", "n", "keep", "size", "first"]
    lone = alone.withColumns({"keep": F.col("id"), "size": F.col("n"), "first": F.lit(True)})
    return grouped.select(names).union(lone.select(names))


def with_several(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with the column ``name``: true where another row has the id too (null ids are one id). Only such rows
    need their text to be told apart; ids are counted without the texts."""
    own = fresh([*docs.columns, name], "_own")
    ids = docs.groupBy(F.col(id_col).alias(own)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own, F.lit(True).alias(name))
    keyed = docs.withColumn(own, F.col(id_col))
    return join_keys(keyed, ids, [own], salt_by=F.length(F.coalesce(text_col, F.lit(""))).cast("bigint")).drop(own)


def _mark(norm: Column, several: str) -> Column:
    """The hash of the normalised text where the id does not tell the row apart, else 0: no other whole text is
    hashed before refinement has shown that it may have an equal."""
    return F.when(F.col(several), F.xxhash64(norm)).otherwise(F.lit(0).cast("bigint"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``n_points``
    (code points of the original text) and ``full`` (SHA-256 of the normalised text; null where
    refinement showed that no other row can have it).

    Of equal texts the row with the most code points in the original text stays, then the one with
    the smallest id; a null id comes last. Of rows that repeat an id with an equal text of the same
    length, one has ``kept`` true. A null text counts as empty and equals blank ones. An empty table
    gives no rows. Columns named in ``carry`` are passed on; others are not read.
    """
    several = fresh(docs.columns, "_several")
    told = with_several(docs, id_col, text_col, several)
    out = _decided(told, several, id_col, text_col, carry).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                      (F.col("first") & (F.col("copy") == 1)).alias("kept"), F.col("points").alias("n_points"), "full", *[F.col("carried")[c].alias(c) for c in carry])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct normalised text, with all their columns
    whatever their names. Of rows that repeat an id with equal texts of one length any one stays; rows
    with different texts stay whatever their ids."""
    names = docs.columns
    several = fresh(names, "_several")
    told = with_several(docs, id_col, text_col, several)
    decided = _decided(told, several, id_col, text_col)
    # a row that has its id alone stays unless its id is among those that go: only ids meet
    own, gone = fresh(names, "_own"), fresh(names, "_gone")
    going = decided.where("many is null and not first").select(F.col("id").alias(own), F.lit(True).alias(gone))
    alone = told.where(F.col(several).isNull()).withColumn(own, F.col(id_col))
    size = F.length(F.coalesce(text_col, F.lit(""))).cast("bigint")
    lone = join_keys(alone, going, [own], salt_by=size).where(F.col(gone).isNull())
    # rows that share an id are told apart by their text too
    id_, unnamed, mark, points = key = [fresh(names, f"_{x}") for x in ("id", "unnamed", "mark", "points")]
    nothing = F.lit("0").cast(docs.schema[id_col].dataType)
    stays = decided.where("many and first").select(F.coalesce("id", nothing).alias(id_), F.col("id").isNull().alias(unnamed), F.col("mark").alias(mark), F.col("points").alias(points))
    named = {id_: F.coalesce(F.col(id_col), nothing), unnamed: F.col(id_col).isNull(), mark: _mark(normalised(F.col(text_col)), several), points: size.cast("int")}
    shared = told.where(several).withColumns(named).join(unsent(stays), key).dropDuplicates(key)
    return lone.select(*names).union(shared.select(*names))
