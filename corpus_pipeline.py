"""Corpus pipeline: toxic documents go, then copies, then near copies; sources are
mixed to target weights; what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.llm import bpe, exact_dedup, mixing, simhash, toxicity
from versio.llm.common import fresh, join_keys, unsent, written
from versio.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. A null or empty text is not toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id, and of rows that share it that
    with the smallest text hash. Each row is decided alone, by its id and the hash of its text, so rows
    that share an id need not go together; rows without an id come last. Of rows with equal id and text
    one stays. A row with neither id nor text stays, since there is nothing to tell what it copies."""
    unnamed, own, mark, several, gone = (fresh(docs.columns, x) for x in ("_unnamed", "_id", "_mark", "_several", "_gone"))
    key, nothing = [unnamed, own, mark], F.lit("0").cast(docs.schema["doc_id"].dataType)
    told = exact_dedup.with_several(docs, "doc_id", "text", several)
    # the text tells apart only rows that share an id
    hashed = F.when(F.col(several), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))
    keyed = told.withColumns({unnamed: F.col("doc_id").isNull(), own: F.coalesce("doc_id", nothing), mark: hashed})
    rows = keyed.where("doc_id is not null or text is not null").select(F.struct(*key, several).alias("row"), "text")
    found = simhash.simhash_components(rows, "row", words=3, max_bits=2)
    going = written(found.where("row <> component_id").select("row.*"), "near-copies")
    alone, shared = keyed.where(F.col(several).isNull()), keyed.where(several)
    ids = going.where(F.col(several).isNull()).select(unnamed, own, F.lit(True).alias(gone))
    lone = join_keys(alone, ids, [unnamed, own], salt_by=F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).where(F.col(gone).isNull())
    left = shared.join(unsent(going.where(several)), key, "left_anti").dropDuplicates(key)
    return lone.select(*docs.columns).union(left.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source's expected share is that of the square root of its size, in a
    global random order."""
    names = docs.columns
    return mixing.replicate(docs, power=0.5, seed=42, copy_col=fresh(names, "_copy"), order_col=fresh(names, "_order")).select(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, one row for each row."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learned stage is no SQL: the pipeline is tested against a plain Python version.
ORACLE_SQL = None
