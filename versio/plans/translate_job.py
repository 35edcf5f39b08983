"""End-to-end document translation job (the reference's CLI run, for a table).

documents -> chunk_documents -> target languages -> translate
-> written translations -> reassemble + usage (+ cost)

Exchanges: one round-robin before each round of requests (as many tasks as requests
may be open), one hash aggregation by (doc_id, target_lang) for reassembly and one for
usage. The rounds are tables below ``spark.checkpoint.dir``, so every chunk is sent once
even though several results read it. With ``sink`` the answers are committed there in
units instead, and a run that died goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.functions.text import DEFAULT_CHUNK_TOKENS, is_blank
from versio.operators import checks
from versio.operators.assemble import ordered_chunks, reassemble
from versio.operators.chunk import chunk_documents, chunk_pages
from versio.operators.dispatch import answer_units, translate
from versio.operators.pages import full_text_units, pages_from_rows
from versio.operators.usage import estimate_cost, usage_by_document
from versio.session import materialize
from versio.sources.dimensions import DEFAULT_CONCURRENCY


@dataclass
class TranslationRun:
    chunks: DataFrame
    translations: DataFrame
    documents: DataFrame
    usage: DataFrame
    # per input document: n_pages and status ok / no_pages / empty_extraction, so a
    # document that yields no chunk (the reference raises) is reported, not lost
    status: DataFrame | None = None
    # the documents' text at chunk grain, range-partitioned and in order
    pieces: DataFrame | None = None


def with_targets(units: DataFrame, target_langs: Sequence[str]) -> DataFrame:
    """One task per unit and target language (a fixed, caller-given list)."""
    return units.withColumn("target_lang", F.explode(F.array(*[F.lit(t) for t in target_langs])))


def plan_chunks(documents: DataFrame, *, limit: int = DEFAULT_CHUNK_TOKENS, full_text: bool = False,
                text_col: str = "text") -> DataFrame:
    """documents(doc_id, text) -> chunks(doc_id, page_idx, chunk_idx, chunk, ...)."""
    if full_text:
        return full_text_units(documents, text_col=text_col)
    return chunk_documents(documents, limit, text_col=text_col)


def translate_documents(
    documents: DataFrame,
    service,
    *,
    target_langs: Sequence[str] = ("en",),
    limit: int = DEFAULT_CHUNK_TOKENS,
    full_text: bool = False,
    **run_opts,
) -> TranslationRun:
    """The whole run for documents(doc_id, text) whose text carries page markers.
    Options as ``run_chunks``."""
    chunks = plan_chunks(documents, limit=limit, full_text=full_text)
    run = run_chunks(chunks, service, target_langs=target_langs, **run_opts)
    run.status = checks.document_status(documents.select("doc_id", "text"))
    return run


def translate_page_rows(
    rows: DataFrame,
    service,
    *,
    key: str = "doc_id",
    order: str = "page_no",
    text: str = "text",
    target_langs: Sequence[str] = ("en",),
    limit: int = DEFAULT_CHUNK_TOKENS,
    **run_opts,
) -> TranslationRun:
    """The whole run for documents stored as page rows (key, order, text): the
    pages come from ``pages_from_rows``, so no document is gathered in one task.
    ``run.pieces`` is the result at chunk grain, in order; ``run.documents`` joins
    it to one string per document when it is read. Options as ``run_chunks``."""
    pages = pages_from_rows(rows, key=key, order=order, text=text)
    run = run_chunks(chunk_pages(pages, limit), service, target_langs=target_langs, **run_opts)
    kept = F.count_if(~is_blank(text)).alias("n_pages")
    run.status = (rows.groupBy(F.col(key).alias("doc_id")).agg(kept)
                  .withColumn("status", F.when(F.col("n_pages") == 0, F.lit("no_pages")).otherwise(F.lit("ok"))))
    return run


def run_chunks(
    chunks: DataFrame,
    service,
    *,
    target_langs: Sequence[str] = ("en",),
    concurrency: int = DEFAULT_CONCURRENCY,
    sink: str | None = None,
    unit_rows: int = 100_000,
    stems: DataFrame | None = None,
    model: str | None = None,
    cache: str = "miss",
    strict: bool = False,
    **dispatch_opts,
) -> TranslationRun:
    """chunks -> translations (written by rounds, or committed to ``sink`` in units) -> documents
    (named by ``stems``) + usage (+ cost).

    ``strict`` fails the job when any chunk failed (the reference aborts on a
    failed full-text request); otherwise failed chunks carry the failure marker
    and the run goes on."""
    # languages are expanded inside the dispatch: each chunk crosses the exchange once
    if sink is not None:
        translations = answer_units(chunks, service, sink, unit_rows=unit_rows, concurrency=concurrency,
                                    langs=list(target_langs), **dispatch_opts)
        if translations is None:  # no chunk at all
            translations = translate(chunks, service, concurrency=concurrency, langs=list(target_langs), **dispatch_opts)
    else:
        translations = translate(chunks, service, concurrency=concurrency, langs=list(target_langs),
                                 **dispatch_opts)
    if strict:
        checks.strict(translations.select("status"), F.col("status") == "failed", "a chunk failed to translate").write.format("noop").mode("overwrite").save()
    docs = reassemble(translations, stems)
    usage = usage_by_document(translations)
    if model is not None:
        usage = estimate_cost(usage.withColumn("model", F.lit(model)).withColumn("cache", F.lit(cache)))
    return TranslationRun(chunks, translations, docs, usage, pieces=ordered_chunks(translations))


def translated_with_usage(translations: DataFrame) -> DataFrame:
    """Reassembled text and token totals from ONE aggregation (shared exchange):
    (doc_id, target_lang, content, prompt/completion/total totals, n_failed)."""
    from versio.operators.assemble import ordered_join

    p = F.coalesce("prompt_tokens", F.lit(0).cast("bigint"))
    c = F.coalesce("completion_tokens", F.lit(0).cast("bigint"))
    return translations.groupBy("doc_id", "target_lang").agg(
        ordered_join().alias("content"),
        F.sum(p).cast("bigint").alias("prompt_tokens_total"),
        F.sum(c).cast("bigint").alias("completion_tokens_total"),
        F.sum(p + c).cast("bigint").alias("total_tokens_total"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


@dataclass
class Extraction:
    extracted: DataFrame   # (doc_id, method, text, status) for accepted files
    rejected: DataFrame    # (doc_id, path, suffix) for files of a format not allowed
    files: DataFrame       # (doc_id, path, suffix, stem, route, pdf_name)


def extract_files(spark, directory: str, extractors, *, formats=None) -> Extraction:
    """The reference's front half for a directory of files: list them, check the format, route (pass
    through / convert), run the caller's decoders (``extract.PyExtractor``) on the accepted files, keep
    the longest candidate of each (chosen in its row) and flag blank extractions. Rejected files are
    listed and never read. The converter itself is the caller's: route ``convert`` files are decoded as
    they are. Documents are named by their path."""
    from versio.operators.extract import binary_best
    from versio.sources.files import conversion_route, list_files, scan_files

    listed = list_files(spark, directory, formats=formats).withColumn("doc_id", F.col("path"))
    routed = conversion_route(listed.drop("suffix", "stem", "format_ok"), formats=formats)
    extracted = binary_best(scan_files(spark, directory, formats=formats), extractors)
    rejected = routed.where(~F.col("format_ok")).select("doc_id", "path", "suffix")
    files = routed.select("doc_id", "path", "suffix", "stem", "route", "pdf_name")
    return Extraction(extracted, rejected, files)


def translate_files(spark, directory: str, extractors, service, *, formats=None, full_text: bool = False,
                    limit: int = DEFAULT_CHUNK_TOKENS, **run_opts) -> tuple[Extraction, TranslationRun]:
    """The whole run from a directory of files to documents named ``<stem>_<lang>.md``: ``extract_files``,
    then the translation of what it found. Options as ``run_chunks``; every accepted file has a row in
    ``run.status``, and files with blank or no pages are not sent."""
    found = extract_files(spark, directory, extractors, formats=formats)
    found.extracted = materialize(found.extracted)  # the decoders run once
    stems = found.files.where("route <> 'rejected'").select("doc_id", "stem")
    run = run_chunks(plan_chunks(found.extracted, limit=limit, full_text=full_text), service, stems=stems, **run_opts)
    run.status = checks.document_status(found.extracted.select("doc_id", "text"))
    return found, run
