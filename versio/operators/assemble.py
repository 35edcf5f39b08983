"""Ordered reassembly and the document sink.

``reassemble`` is one hash aggregation on (doc_id, target_lang); ``listagg ...
WITHIN GROUP (ORDER BY page_idx, chunk_idx)`` restores page/chunk order no
matter in which order the answers arrived. Joining every chunk with the same
separator equals joining chunks per page and then pages, because every kept
page has at least one chunk.

The whole-document string is inherent to the output format (one file per
document); a document row is bounded by its source row. ``translations``
(chunk grain) stays the scalable table; ``content`` is a view of it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.functions.text import FAILED_MARKER, JOIN_SEPARATOR, col_of
from versio.sources.named_files import read_files, write_files


def ordered_join(text: str = "translated", order: tuple[str, ...] = ("page_idx", "chunk_idx"),
                 sep: str = JOIN_SEPARATOR) -> Column:
    """listagg(text, sep) WITHIN GROUP (ORDER BY order...); NULL read as the failure marker."""
    sep_sql = sep.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'")
    order_sql = ", ".join(order)
    return F.expr(
        f"listagg(coalesce({text}, '{FAILED_MARKER}'), '{sep_sql}') WITHIN GROUP (ORDER BY {order_sql})"
    )


def output_name(stem, lang) -> Column:
    """``{stem}_{lang}.md``."""
    return F.concat(col_of(stem), F.lit("_"), col_of(lang), F.lit(".md"))


def reassemble(translations: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """translations(doc_id, page_idx, chunk_idx, target_lang, translated, ...) ->
    translated_documents(doc_id, target_lang, output_name, content).

    With ``stems`` (doc_id, stem), as ``scan_files`` gives them, the output is named
    ``<stem>_<lang>.md`` (H12); a document without one, or no ``stems``, is named
    ``doc_<id>_<lang>.md``. Names need not be unique (X19): documents of different folders
    may share a stem, so tables keep ``doc_id``."""
    own = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    done = translations.groupBy("doc_id", "target_lang").agg(ordered_join().alias("content"))
    if stems is not None:
        done = done.join(stems.select("doc_id", F.nullif("stem", F.lit("")).alias("__stem")), "doc_id", "left")
        own = F.coalesce("__stem", own)
    return done.select("doc_id", "target_lang", output_name(own, "target_lang").alias("output_name"), "content")


def ordered_chunks(translations: DataFrame, partitions: int | None = None) -> DataFrame:
    """G1 at chunk grain, for documents of any size: (doc_id, target_lang, page_idx, chunk_idx, piece),
    range-partitioned and sorted, where the pieces of a document in this order are its content.
    No task holds a whole document: the sampled bounds split a large one."""
    order = ["doc_id", "target_lang", "page_idx", "chunk_idx"]
    text = F.coalesce("translated", F.lit(FAILED_MARKER))
    opening = (F.col("page_idx") == 0) & (F.col("chunk_idx") == 0)
    rows = translations.select(*order, F.concat(F.when(opening, "").otherwise(JOIN_SEPARATOR), text).alias("piece"))
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def _version() -> str:
    """A name that sorts by time."""
    now = time.time_ns()
    return f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime(now // 10**9))}.{now % 10**9:09d}-{uuid.uuid4().hex[:8]}"


def write_documents(docs: DataFrame, path: str) -> None:
    """K1: add translated documents to the Parquet table at ``path``, as a version of their own.

    Nothing that another call wrote is touched: a document or language that is not in ``docs`` stays,
    one that is gets a newer version (``read_documents`` shows the newest)."""
    docs.write.partitionBy("target_lang").parquet(f"{path.rstrip('/')}/version={_version()}")


#: Folder of the manifests of a document table; the one whose name sorts last holds.
MANIFESTS = "_manifests"
_KEY = ["doc_id", "target_lang"]


def _store(spark: SparkSession, path: str):
    """(Hadoop file system, its Path of a string)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, folder: str) -> list[str]:
    store, make = _store(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(make(folder))) if store.exists(make(folder)) else []


def _manifest(spark: SparkSession, path: str) -> dict:
    """The current manifest: ``base``, the folder of the merged table, and ``merged``, the versions in it."""
    names = [n for n in _names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json")]
    if not names:
        return {"base": None, "merged": []}
    return json.loads(spark.read.text(f"{path}/{MANIFESTS}/{names[-1]}", wholetext=True).first()[0])


def _newest(rows: DataFrame) -> DataFrame:
    """Of several versions of a key the newest; versions are compared without the texts."""
    top = rows.groupBy(*_KEY).agg(F.max("__version").alias("__newest"))
    return rows.join(top, _KEY).where(F.col("__version") == F.col("__newest")).drop("__newest")


def _current(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(the newest version of each key with ``__version``, the versions read)."""
    manifest = _manifest(spark, path)
    versions = [n.removeprefix("version=") for n in _names(spark, path) if n.startswith("version=")]
    later = [v for v in versions if v not in set(manifest["merged"])]
    new = base = None
    if later:
        read = spark.read.option("basePath", path).parquet(*(f"{path}/version={v}" for v in later))
        new = _newest(read.withColumn("__version", F.col("version").cast("string")).drop("version"))
    if manifest["base"]:
        base = spark.read.parquet(f"{path}/{MANIFESTS}/{manifest['base']}")
    if new is None or base is None:
        if new is None and base is None:
            raise FileNotFoundError(f"no document table at {path}")
        return (new if base is None else base), later
    # only keys with a later version are compared with it, the others are read as they are
    keys = new.select(*_KEY)
    contest = _newest(base.join(keys, _KEY, "left_semi").unionByName(new, allowMissingColumns=True))
    return base.join(keys, _KEY, "left_anti").unionByName(contest, allowMissingColumns=True), later


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each document and language in a table of ``write_documents``. After
    ``compact_documents`` the cost is that of the table and of what was written since."""
    return _current(spark, path.rstrip("/"))[0].drop("__version")


def compact_documents(spark: SparkSession, path: str) -> int:
    """Merge the versions of the table into one, in ranges of documents, and return how many were merged.

    The merged table counts from the moment its manifest has its name (one rename); nothing is deleted, so readers
    that began before go on, and versions written meanwhile are read beside it. ``drop_merged`` deletes what no
    reader needs any more."""
    path = path.rstrip("/")
    now, later = _current(spark, path)
    if not later:
        return 0
    manifest, version = _manifest(spark, path), _version()
    base = f"base-{version}"
    now.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).write.parquet(f"{path}/{MANIFESTS}/{base}")
    store, make = _store(spark, path)
    held = set(_names(spark, path))
    merged = sorted({v for v in manifest["merged"] if f"version={v}" in held} | set(later))
    draft = make(f"{path}/{MANIFESTS}/draft-{version}")
    out = store.create(draft)
    out.write(bytearray(json.dumps({"base": base, "merged": merged}).encode()))
    out.close()
    if not store.rename(draft, make(f"{path}/{MANIFESTS}/{version}.json")):
        raise OSError(f"the manifest of {path} could not be renamed")
    return len(later)


def drop_merged(spark: SparkSession, path: str) -> int:
    """Delete the versions that the current manifest holds merged, and earlier merged tables and manifests; returns
    the number of folders and files. For when no reader that began before the last compaction is left."""
    path = path.rstrip("/")
    manifest, (store, make) = _manifest(spark, path), _store(spark, path)
    if not manifest["base"]:
        return 0
    held = _names(spark, f"{path}/{MANIFESTS}")
    last = max(n for n in held if n.endswith(".json"))
    gone = [f"{path}/{MANIFESTS}/{n}" for n in held if n not in (last, manifest["base"])]
    gone += [f"{path}/version={v}" for v in manifest["merged"] if store.exists(make(f"{path}/version={v}"))]
    for folder in gone:
        store.delete(make(folder), True)
    return len(gone)


def file_name(stems: DataFrame | None, translations: DataFrame) -> DataFrame:
    """``translations`` with ``output_name``, the file's stem and language (H12); a document without a stem is
    named by its id. A name is one path component: a slash in it is written %2F."""
    own, named = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), translations
    if stems is not None:
        named = translations.join(stems.select("doc_id", F.nullif("stem", F.lit("")).alias("__stem")), "doc_id", "left")
        own = F.coalesce("__stem", own)
    return named.withColumn("output_name", F.replace(output_name(own, "target_lang"), F.lit("/"), F.lit("%2F"))).drop("__stem")


def export_markdown(translations: DataFrame, path: str, *, stems: DataFrame | None = None, partitions: int | None = None,
                    clash: str = "fail") -> None:
    """K1: one UTF-8 file ``{stem}_{lang}.md`` per document and language in the folder ``path`` of any store.

    A file of the same name is replaced, no other is touched; a failed run leaves nothing (see
    ``sources.named_files``). Chunks are range-partitioned, so a long document is written by several tasks, and its
    size is bounded by the store alone. Documents of different folders may have one name (X19): ``clash="fail"`` refuses them before anything
    is written, ``clash="last"`` keeps the document with the largest id, as runs one after the other would.
    """
    if clash not in ("fail", "last"):
        raise ValueError("clash is 'fail' or 'last'")
    named = file_name(stems, translations)
    names = named.groupBy("output_name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("target_lang").alias("lang"))
    shared = names.where("first <> last")
    if clash == "fail":
        some = [r.output_name for r in shared.select("output_name").take(5)]
        if some:
            raise ValueError(f"several documents have one file name, such as {some}")
    else:  # a document that holds a shared name is the last one, or goes; most hold a name of their own
        kept = names.select(F.col("last").alias("doc_id"), F.col("lang").alias("target_lang"))
        named = named.join(kept, ["doc_id", "target_lang"], "left_semi")
    write_files(file_pieces(named, partitions), path)


def file_pieces(named: DataFrame, partitions: int | None = None) -> DataFrame:
    """(output_name, piece) in order over range partitions, of ``file_name``'s rows: the pieces of a name make its file."""
    opening = (F.col("page_idx") == 0) & (F.col("chunk_idx") == 0)
    piece = F.concat(F.when(opening, "").otherwise(JOIN_SEPARATOR), F.coalesce("translated", F.lit(FAILED_MARKER)))
    order = ["output_name", "page_idx", "chunk_idx"]
    rows = named.select(*order, piece.alias("piece"))
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select("output_name", "piece")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(output_name, content) of every file of ``export_markdown`` in the folder ``path``."""
    return read_files(spark, path).withColumnRenamed("name", "output_name")
