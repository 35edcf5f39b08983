"""Document sources and file checks.

``scan_files`` reads a directory of documents with Spark's ``binaryFile``
source; the allowed formats are its file-name glob, so other files are listed
(``list_files``) and never read. The name checks are column
expressions, so they run on a listing of millions of paths without a job of
their own; ``missing_files`` is one anti join of a manifest against the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.functions.text import col_of
from versio.sources.dimensions import SUPPORTED_FORMATS

# Python ``Path.suffix``: the last ".xxx" of the last path component, where a
# leading dot of the component does not count ("/a/.pdf" has no suffix).
_SUFFIX_RE = r"[^/.][^/]*?(\.[^./]+)$"


def file_suffix(path) -> Column:
    """H8: lower-cased suffix (``Path.suffix.lower()``), '' when none."""
    return F.lower(F.regexp_extract(col_of(path), _SUFFIX_RE, 1))


def file_stem(path) -> Column:
    """H8: last path component without its suffix (``Path.stem``)."""
    name = F.regexp_extract(col_of(path), r"([^/]*)$", 1)
    suffix = F.regexp_extract(col_of(path), _SUFFIX_RE, 1)
    return F.when(suffix == "", name).otherwise(
        F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))


def parse_formats(spec: str | Sequence[str] | None) -> list[str]:
    """Comma list of allowed suffixes; entries are trimmed and lower-cased
    (documented deviation: the reference does not trim)."""
    if spec is None:
        return list(SUPPORTED_FORMATS)
    items = spec.split(",") if isinstance(spec, str) else list(spec)
    return [s.strip().lower() for s in items if s.strip()]


def validate_formats(files: DataFrame, *, path_col: str = "path", formats=None) -> DataFrame:
    """A3: adds suffix, stem and ``format_ok``."""
    allowed = parse_formats(formats)
    suf = file_suffix(path_col)
    return files.select(
        "*", suf.alias("suffix"), file_stem(path_col).alias("stem"), suf.isin(allowed).alias("format_ok")
    )


def conversion_route(files: DataFrame, *, path_col: str = "path", formats=None) -> DataFrame:
    """A4: 'passthrough' for PDFs, 'convert' for other allowed formats (target
    ``{stem}.pdf``), 'rejected' otherwise. The converter itself is the caller's."""
    v = validate_formats(files, path_col=path_col, formats=formats)
    route = (F.when(~F.col("format_ok"), F.lit("rejected"))
             .when(F.col("suffix") == ".pdf", F.lit("passthrough"))
             .otherwise(F.lit("convert")))
    target = F.when(route == "convert", F.concat(F.col("stem"), F.lit(".pdf")))
    return v.select("*", route.alias("route"), target.alias("pdf_name"))


def format_glob(formats=None) -> str:
    """A file-name glob for the allowed suffixes, in any case."""
    def any_case(suffix: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and len(c.upper()) == 1 else c for c in suffix)

    return "{" + ",".join(f"*{any_case(x)}" for x in parse_formats(formats)) + "}"


def list_files(spark: SparkSession, directory: str, *, formats=None, recursive: bool = True) -> DataFrame:
    """Every file below a directory -> (path, length, suffix, stem, format_ok); no content is read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(directory).select("path", "length"))
    return validate_formats(df, path_col="path", formats=formats)


def scan_files(spark: SparkSession, directory: str, *, formats=None, recursive: bool = True) -> DataFrame:
    """A1: documents of the allowed formats -> (doc_id, path, length, content, suffix, stem, format_ok).

    The formats are pushed into the listing as a file-name glob, so the bytes of other files are never
    read (``list_files`` names them). ``doc_id`` is the path: stable, and no two files share it."""
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", str(recursive).lower())
          .option("pathGlobFilter", format_glob(formats))
          .load(directory))
    v = validate_formats(df, path_col="path", formats=formats).where("format_ok")
    return v.select(F.col("path").alias("doc_id"), "path", "length", "content", "suffix", "stem", "format_ok")


def missing_files(manifest: DataFrame, present: DataFrame, *, key: str = "name") -> DataFrame:
    """A2: manifest entries with no scanned file -> (key, status='missing').

    A left anti join on the name; both sides shuffle on the key (or the
    listing is broadcast by AQE when it is small)."""
    return (manifest.join(present.select(key).distinct(), key, "left_anti")
            .select(key, F.lit("missing").alias("status")))
