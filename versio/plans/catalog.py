"""Registered queries: one per operator group of the survey's inventory.

Every query reads the driver's tables (or rows Spark derives from them) in
full; none caps, samples or subsets rows. Each returns a DataFrame whose
columns are aliased exactly like its SQL twin in ``oracle_sql.ORACLES``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.functions.text import approx_tokens
from versio.operators import checks, extract, request, response, usage
from versio.operators.assemble import compact_documents, export_markdown, read_documents, read_markdown, reassemble, write_documents
from versio.operators.chunk import chunk_counts, chunk_documents, chunk_pages
from versio.operators.dispatch import answer_units, translate
from versio.operators.long_pages import chunk_long_pages
from versio.operators.pages import full_text_units, no_page_documents, page_counts, pages_from_rows, split_pages
from versio.operators.services import get_service
from versio.plans.standins import EchoService, FlakyService, failures_by_length
from versio.plans import standins as S
from versio.plans.translate_job import translated_with_usage, with_targets
from versio.session import ensure_checkpoint_dir, materialize
from versio.sources.files import conversion_route, missing_files, scan_files, validate_formats
from versio.sources.marked_files import marked_file_pages
from versio.sources.named_files import write_files
from versio.streaming.usage import answer_stream, current_usage, usage_stream

Query = Callable[[SparkSession, str], DataFrame]

STUB_LANG = "pt"
CHUNK_COLS = ["doc_id", "page_idx", "chunk_idx", "chunk", "chunk_tokens"]
TRANSLATION_COLS = ["doc_id", "page_idx", "chunk_idx", "target_lang", "translated", "status", "attempts",
                    "prompt_tokens", "completion_tokens", "usage_reported"]


# --- shared building blocks -------------------------------------------------

def _doc_pages(spark, sf):
    return split_pages(S.documents(spark, sf))


def _doc_chunks(spark, sf, limit):
    return chunk_documents(S.documents(spark, sf), limit)


def _no_wait(_seconds: float) -> None:
    """The stand-in service has no rate limit; waits are computed but not slept."""


def _echo_translations(spark, sf, limit=2000, keep_text=False):
    return translate(_doc_chunks(spark, sf, limit), EchoService(), concurrency=8, sleep=_no_wait,
                     keep_text=keep_text, langs=[STUB_LANG])


def _flaky_translations(spark, sf, limit=200):
    tasks = with_targets(_doc_chunks(spark, sf, limit), [STUB_LANG])
    svc = FlakyService(EchoService(), failures_by_length(4))
    return translate(tasks, svc, concurrency=8, sleep=_no_wait)


def _conv_marked(spark, sf):
    conv = S.read(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return extract.mark_pages(conv, key="conv_id", order="turn").withColumnRenamed("conv_id", "doc_id")


# --- A: sources -------------------------------------------------------------

def q_validate_formats(spark, sf):
    v = validate_formats(S.file_manifest(spark, sf))
    return v.select("doc_id", "path", "suffix", "stem", "format_ok")


def q_conversion_route(spark, sf):
    r = conversion_route(S.file_manifest(spark, sf))
    return r.select("doc_id", "path", "route", "pdf_name")


def q_custom_formats(spark, sf):
    """A6 + H15: a comma list of formats, blanks and upper case allowed."""
    v = validate_formats(S.file_manifest(spark, sf), formats=" .PDF, .txt,,.Gz ")
    return v.select("doc_id", "path", "suffix", "format_ok")


def q_missing_files(spark, sf):
    m = S.file_manifest(spark, sf).withColumnRenamed("path", "name")
    p = S.present_files(spark, sf).withColumnRenamed("path", "name")
    return missing_files(m, p)


def _folder(spark, label):
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def q_scan_files(spark, sf):
    """A1 + H8: every document written as a file, those of the allowed formats read back as bytes."""
    folder = _folder(spark, "files")
    write_files(S.named_texts(spark, sf), folder)
    found = scan_files(spark, folder, formats=" .PDF, .txt,.Gz")
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length", F.sha2("content", 256).alias("content_sha256"), "suffix", "stem")


def q_file_pages(spark, sf):
    """A1 + C1: pages of marker-separated files, a file per source, each read by as many tasks as it has blocks."""
    folder = _folder(spark, "marked")
    write_files(S.source_files(spark, sf), folder)
    pages = marked_file_pages(spark, folder)
    return pages.select(F.regexp_extract("doc_id", "[^/]*$", 0).alias("name"), "page_idx", "page")


# --- B: extraction ------------------------------------------------------------

def _html(spark, sf):
    return S.read(spark, sf, "pages", ["page_id", "html"])


def q_extract_candidates(spark, sf):
    return extract.html_candidates(_html(spark, sf)).select("doc_id", "method", "priority", "text")


def q_extract_best(spark, sf):
    return extract.html_best(_html(spark, sf))


def q_extraction_stats(spark, sf):
    return extract.extraction_stats(extract.html_candidates(_html(spark, sf)))


def q_choose_best(spark, sf):
    return extract.choose_best(extract.html_candidates(_html(spark, sf)))


def q_choose_best_stored(spark, sf):
    """B6 + B7 on a stored table of candidates: texts stay where they lie."""
    folder = _folder(spark, "candidates")
    extract.html_candidates(_html(spark, sf)).drop("chosen", "error").repartition(8).write.parquet(folder)
    return extract.choose_best_stored(spark, folder)


def q_extract_binary(spark, sf):
    """The decoder hook on the pages' bytes: a paged and an unpaged decoder, the longer text wins."""
    files = S.read(spark, sf, "pages", ["page_id", "html"]).select(
        F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    decoders = [extract.PyExtractor("paragraphs", 1, S.paragraphs),
                extract.PyExtractor("head", 2, S.head_and_title, paged=False)]
    return extract.binary_best(files, decoders)


def q_mark_pages(spark, sf):
    return _conv_marked(spark, sf)


def q_document_status(spark, sf):
    return checks.document_status(extract.html_best(_html(spark, sf)))


# --- C: pages -------------------------------------------------------------------

def q_split_pages(spark, sf):
    return split_pages(S.marked_documents(spark, sf))


def q_page_rows(spark, sf):
    """C1 on page rows: the same pages as ``split_pages`` of the marked text,
    with the dense index computed without gathering a document in one task."""
    conv = S.read(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return pages_from_rows(conv, key="conv_id", order="turn")


def q_page_counts(spark, sf):
    return page_counts(S.marked_documents(spark, sf))


def q_no_page_documents(spark, sf):
    """Documents without a non-blank page, NULL and blank texts included."""
    return no_page_documents(S.uneven_documents(spark, sf))


def q_uneven_status(spark, sf):
    """B7 + C2: the status of every document, sent or not."""
    return checks.document_status(S.uneven_documents(spark, sf))


# --- D: chunking ----------------------------------------------------------------

def q_approx_tokens(spark, sf):
    d = S.documents(spark, sf)
    return d.select("doc_id", approx_tokens("text").alias("tokens"))


def _chunks_query(limit, native=False):
    def q(spark, sf):
        if native:
            return chunk_pages(_doc_pages(spark, sf), limit, native=True).select(*CHUNK_COLS)
        return _doc_chunks(spark, sf, limit).select(*CHUNK_COLS)
    q.__doc__ = f"D1-D5: chunks of every document page at limit {limit}" + (" (JVM twin)" if native else "")
    return q


def q_chunk_stats(spark, sf):
    return chunk_counts(_doc_pages(spark, sf), 200)


def q_conversation_chunks(spark, sf):
    """Chunks of conversations, a page per turn, without gathering a conversation in one task."""
    conv = S.read(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return chunk_pages(pages_from_rows(conv, key="conv_id", order="turn"), 200).select(*CHUNK_COLS)


def q_chunks_long_pages(spark, sf):
    """D1-D5 on pages cut into blocks of eight lines, packed in parallel: equal to ``chunks_200``."""
    lines = _doc_pages(spark, sf).select("doc_id", "page_idx", F.posexplode(F.split("page", "\n", -1)).alias("line_no", "line"))
    return chunk_long_pages(lines, 200, block_lines=8).select(*CHUNK_COLS)


def q_chunk_edges(spark, sf):
    """Blank lines, tabs, no-break spaces and very long words."""
    return chunk_documents(S.edge_documents(spark, sf), 20).select(*CHUNK_COLS)


# --- E: requests, dispatch, replies ---------------------------------------------

def _requests(spark, sf):
    """Routed chunks with the resolved provider and model, and the request body."""
    ch = chunk_documents(S.routed_documents(spark, sf), 2000, carry=("target_lang", "provider", "model"))
    r = request.resolve_models(ch)
    return request.build_requests(r.withColumns({"provider": F.col("provider_resolved"), "model": F.col("model_resolved")}))


def q_build_requests(spark, sf):
    """Every chunk's request; chunks without a route or with an unknown provider have a NULL body."""
    body = F.from_json("body", "model STRING, max_tokens INT, temperature DOUBLE, system STRING, contents STRING, "
                       "messages ARRAY<STRUCT<role: STRING, content: STRING>>, "
                       "config STRUCT<temperature: DOUBLE, max_output_tokens: INT, system_instruction: STRING>")
    r = _requests(spark, sf).select("*", F.explode_outer(F.array(body)).alias("b"))
    return r.select("doc_id", "page_idx", "chunk_idx", "target_lang", "provider", "model", "status", "request_style",
                    "user", "temperature", "max_tokens", F.col("b.model").alias("body_model"),
                    F.coalesce(F.element_at("b.messages", -1)["content"], "b.contents").alias("body_user"),
                    F.coalesce(F.when(F.size("b.messages") > 1, F.col("b.messages")[0]["content"]), "b.system", "b.config.system_instruction").alias("body_system"),
                    F.coalesce("b.temperature", "b.config.temperature").alias("body_temperature"),
                    F.coalesce("b.max_tokens", "b.config.max_output_tokens").alias("body_max_tokens"))


def q_send_requests(spark, sf):
    """E2 -> table-driven dispatch -> E12-E17: requests for every chunk sent through an offline
    transport answering in each provider's shape, and the raw replies parsed in the JVM. Requests
    without a body are not posted and come back as failed after 0 attempts."""
    from versio.operators.dispatch import send_requests
    from versio.plans.standins import EchoTransport

    replies = send_requests(_requests(spark, sf), EchoTransport(), concurrency=8, sleep=_no_wait)
    return response.parse_responses(replies).select(
        "doc_id", "page_idx", "chunk_idx", "target_lang", "provider", "translated", "status", "attempts",
        "prompt_tokens", "completion_tokens", "usage_reported")


def q_resolve_aliases(spark, sf):
    """Model specs with the caller's alias list."""
    r = request.resolve_models(S.model_specs(spark, sf), aliases=S.ALIASES)
    return r.select("doc_id", "provider", "model", "provider_resolved", "model_resolved", "model_known", "status")


def q_resolve_models(spark, sf):
    r = request.resolve_models(S.model_specs(spark, sf))
    return r.select("doc_id", "provider", "model", "provider_resolved", "model_resolved", "model_known", "status")


def q_parse_responses(spark, sf):
    p = response.parse_responses(S.raw_replies(spark, sf))
    return p.select("doc_id", "reply_style", "translated", "status", "prompt_tokens", "completion_tokens",
                    "usage_reported")


def q_translate_stub(spark, sf):
    return _echo_translations(spark, sf).select(*TRANSLATION_COLS)


def q_translate_failures(spark, sf):
    return _flaky_translations(spark, sf).select(*TRANSLATION_COLS)


def q_full_text_mode(spark, sf):
    """Whole documents, markers included, one request each; those without a page are not sent."""
    units = with_targets(full_text_units(S.marked_documents(spark, sf)), [STUB_LANG])
    return translate(units, EchoService(), concurrency=8, sleep=_no_wait).select(*TRANSLATION_COLS)


def q_full_text_failures(spark, sf):
    """E11 + C6: full-text requests of which some fail for good, with the documents that were not sent."""
    docs = S.uneven_documents(spark, sf)
    svc = FlakyService(EchoService(), S.failures_by_key(lambda text: len(text) % 5 == 0))
    sent = translate(with_targets(full_text_units(docs), [STUB_LANG]), svc, concurrency=8, sleep=_no_wait)
    answers = sent.select("doc_id", F.col("status").alias("answer"), "translated", "attempts", "prompt_tokens")
    state = checks.document_status(docs)
    return state.join(answers, "doc_id", "left").select(
        "doc_id", F.when(F.col("status") == "ok", F.col("answer")).otherwise(F.col("status")).alias("status"),
        "translated", "attempts", "prompt_tokens")


def q_provider_service(spark, sf):
    """F3 + E12-E16: documents through the adapters that the registry gives for two providers, one whose replies tell
    their usage and one whose do not."""
    done = []
    for provider, model in (("anthropic", "claude-3-5-haiku-20241022"), ("gemini", "gemini-2.0-flash")):
        service = get_service(provider, model, S.EchoTransport())
        answers = translate(_doc_chunks(spark, sf, 2000), service, concurrency=8, sleep=_no_wait, langs=[STUB_LANG])
        done.append(answers.select(F.lit(provider).alias("provider"), *TRANSLATION_COLS))
    return done[0].union(done[1])


def q_reply_usage(spark, sf):
    """E12 + F1: what the replies' raw usage says of the provider's cache, and the cost by it."""
    parsed = response.parse_responses(S.cached_replies(spark, sf), raw_usage=True)
    priced = usage.reply_cost(usage.reply_tokens(parsed))
    return priced.select("doc_id", "reply_style", "model", "prompt_tokens", "completion_tokens", "hit_tokens", "miss_tokens",
                         F.try_variant_get("usage", "$.completion_tokens_details.reasoning_tokens", "bigint").alias("reasoning_tokens"),
                         "cost_usd", "cost_status")


def q_resume_failed(spark, sf):
    """The chunks that a first pass failed are answered by a second one; the others are not sent again."""
    first = materialize(_flaky_translations(spark, sf))
    tasks = with_targets(_doc_chunks(spark, sf, 200), [STUB_LANG])
    second = translate(tasks, EchoService(), concurrency=8, sleep=_no_wait, resume_from=first)
    both = first.where("status = 'ok'").withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    return both.select(*TRANSLATION_COLS, "pass")


# --- G/F: reassembly, usage, cost --------------------------------------------------

def q_reassemble(spark, sf):
    """G1 + H12: documents named by the stem of their file."""
    stems = validate_formats(S.file_manifest(spark, sf)).select("doc_id", "stem")
    return reassemble(_echo_translations(spark, sf), stems)


def q_export_markdown(spark, sf):
    """K1 + H12: translated documents as Markdown files, read back from their folder."""
    folder = _folder(spark, "markdown")
    stems = validate_formats(S.file_manifest(spark, sf)).select("doc_id", "stem")
    export_markdown(_echo_translations(spark, sf), folder, stems=stems, clash="last")
    return read_markdown(spark, folder).select("output_name", F.sha2("content", 256).alias("content_sha256"), F.length("content").alias("n_chars"))


def q_usage_by_document(spark, sf):
    return usage.usage_by_document(_flaky_translations(spark, sf))


def q_usage_total(spark, sf):
    return usage.usage_total(_flaky_translations(spark, sf))


def q_document_table(spark, sf):
    """K1: a table of documents written twice (drafts, then all documents), compacted and read."""
    folder = _folder(spark, "documents")
    docs = reassemble(_echo_translations(spark, sf), validate_formats(S.file_manifest(spark, sf)).select("doc_id", "stem"))
    write_documents(docs.withColumn("content", F.lit("draft")), folder)
    compact_documents(spark, folder)
    write_documents(docs, folder)
    return read_documents(spark, folder).select("doc_id", F.col("target_lang").cast("string").alias("target_lang"), "output_name", "content")


def q_usage_stream(spark, sf):
    """G2, G3, G5 on a stream: totals of the answers as they are committed, unit by unit, failures and their retries
    included; a chunk counts once."""
    sink, table = _folder(spark, "answers"), _folder(spark, "usage")
    svc = FlakyService(EchoService(), failures_by_length(4))
    answer_units(_doc_chunks(spark, sf, 200), svc, sink, langs=[STUB_LANG], unit_rows=50_000, concurrency=8, sleep=_no_wait)
    answers = answer_stream(spark, sink, spark.read.parquet(f"{sink}/run=*/unit=*").schema, max_files_per_trigger=1_000)
    usage_stream(answers, table, _folder(spark, "usage-checkpoint")).awaitTermination()
    return current_usage(spark, table)


def q_chunks_per_page(spark, sf):
    return usage.chunks_per_page(_doc_chunks(spark, sf, 20))


def _priced(spark, sf):
    u = usage.usage_by_document(_echo_translations(spark, sf))
    return usage.estimate_cost(S.cost_specs(u))


def q_estimate_cost(spark, sf):
    return _priced(spark, sf).select("doc_id", "target_lang", "model", "cache", "prompt_tokens_total",
                                     "completion_tokens_total", "cost_usd", "cost_status")


def q_usage_report(spark, sf):
    r = usage.usage_report(_priced(spark, sf))
    return r.select("doc_id", "target_lang", "prompt_tokens_total", "completion_tokens_total",
                    "total_tokens_total", "cost_status", "cost_text")


def q_translate_documents(spark, sf):
    """The whole run: documents -> pages -> chunks (2000) -> stand-in service ->
    reassembled text with token totals, one aggregation."""
    return translated_with_usage(_echo_translations(spark, sf))


def q_sql_functions(spark, sf):
    """U3/U4 from SQL: token estimate, chunk count and cost per document."""
    from versio.functions.sql import register

    register(spark)
    return spark.sql("""
        SELECT doc_id,
               approx_tokens(text) AS tokens,
               CAST(size(chunk_text(text, 200)) AS BIGINT) AS n_chunks,
               estimate_cost('deepseek-chat', approx_tokens(text), n_chars, 'miss') AS cost_usd
        FROM {docs}""", docs=S.documents(spark, sf))


def q_chunks_table_function(spark, sf):
    """U3 + D1-D5 as a table function in SQL."""
    from versio.functions.sql import register

    register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunks(d.text, 200) c", docs=S.documents(spark, sf))


def q_preservation_check(spark, sf):
    return checks.preservation_check(_echo_translations(spark, sf, keep_text=True))


QUERIES: dict[str, Query] = {
    "validate_formats": q_validate_formats,
    "conversion_route": q_conversion_route,
    "custom_formats": q_custom_formats,
    "missing_files": q_missing_files,
    "scan_files": q_scan_files,
    "file_pages": q_file_pages,
    "extract_candidates": q_extract_candidates,
    "extract_best": q_extract_best,
    "choose_best": q_choose_best,
    "choose_best_stored": q_choose_best_stored,
    "extraction_stats": q_extraction_stats,
    "extract_binary": q_extract_binary,
    "mark_pages": q_mark_pages,
    "document_status": q_document_status,
    "split_pages": q_split_pages,
    "page_rows": q_page_rows,
    "page_counts": q_page_counts,
    "no_page_documents": q_no_page_documents,
    "uneven_status": q_uneven_status,
    "approx_tokens": q_approx_tokens,
    "chunks_2000": _chunks_query(2000),
    "chunks_200": _chunks_query(200),
    "chunks_20": _chunks_query(20),
    "chunks_1": _chunks_query(1),
    "chunks_native_200": _chunks_query(200, native=True),
    "chunks_native_20": _chunks_query(20, native=True),
    "chunk_stats": q_chunk_stats,
    "conversation_chunks": q_conversation_chunks,
    "chunks_long_pages": q_chunks_long_pages,
    "chunk_edges": q_chunk_edges,
    "build_requests": q_build_requests,
    "send_requests": q_send_requests,
    "resolve_models": q_resolve_models,
    "resolve_aliases": q_resolve_aliases,
    "parse_responses": q_parse_responses,
    "translate_stub": q_translate_stub,
    "translate_failures": q_translate_failures,
    "full_text_mode": q_full_text_mode,
    "full_text_failures": q_full_text_failures,
    "resume_failed": q_resume_failed,
    "provider_service": q_provider_service,
    "reply_usage": q_reply_usage,
    "reassemble": q_reassemble,
    "export_markdown": q_export_markdown,
    "document_table": q_document_table,
    "usage_by_document": q_usage_by_document,
    "usage_total": q_usage_total,
    "usage_stream": q_usage_stream,
    "chunks_per_page": q_chunks_per_page,
    "estimate_cost": q_estimate_cost,
    "usage_report": q_usage_report,
    "translate_documents": q_translate_documents,
    "preservation_check": q_preservation_check,
    "sql_functions": q_sql_functions,
    "chunks_table_function": q_chunks_table_function,
}
