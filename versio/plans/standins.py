"""Stand-in inputs derived from the driver's tables.

The reference's inputs are files, CLI options and service replies; the
driver's tables hold text. These builders only shape rows of the schema a
job expects (file names, model specs, raw replies) from the tables, at most
one row per source row, so the work of every job still grows with the tables. They
do none of the jobs' work; the jobs take nothing from how these rows are made.
Each has a SQL twin in ``oracle_sql``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.functions.text import PAGE_SUFFIX, py_approx_tokens
from versio.operators.services import _STYLES, py_user_message
from versio.sources import dimensions as dims
from versio.sources.tables import read_table


def read(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    return read_table(spark, sf_dir, name, columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) - the documents with a page marker at every line end."""
    return documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit(PAGE_SUFFIX)).alias("text"))


def uneven_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) - every document, and for four of nine one more that is NULL, blank, page markers
    alone, or empty, under the id -1 - doc_id."""
    k = F.pmod(F.col("doc_id"), F.lit(9))
    text = F.when(k == 1, " \n\t").when(k == 2, PAGE_SUFFIX + PAGE_SUFFIX).when(k == 3, "")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.union(docs.where(k < 4).select(-1 - F.col("doc_id"), text))


def edge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) - the documents with blank lines, tabs and no-break spaces, or very long words."""
    k = F.pmod(F.col("doc_id"), F.lit(4))
    text = (F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\n\n \n\n")))
            .when(k == 1, F.replace(F.replace("text", F.lit(" "), F.lit("\t")), F.lit("\n"), F.lit("\u00a0\n")))
            .when(k == 2, F.replace("text", F.lit(" "), F.lit("")))
            .otherwise(F.concat(F.lit("\n\n\u2003"), F.replace("text", F.lit(" "), F.lit("\u00a0 ")), F.lit("\n \n"))))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


# file-name shapes picked by doc_id mod 8: (starts with "doc_<id>", suffix)
NAME_SHAPES = [(True, ".pdf"), (True, ".DOCX"), (True, ".txt"), (True, ".odt"), (True, ""),
               (True, ".tar.gz"), (False, ".pdf"), (True, ".v2.Doc")]


def _name(doc_id) -> F.Column:
    stem = F.concat(F.lit("doc_"), doc_id.cast("string"))
    shapes = [F.concat(stem, F.lit(suf)) if use_stem else F.lit(suf) for use_stem, suf in NAME_SHAPES]
    return F.element_at(F.array(*shapes), (F.pmod(doc_id, F.lit(len(NAME_SHAPES))) + 1).cast("int"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path) - one file name per document, under its source folder."""
    d = read(spark, sf_dir, "documents", ["doc_id", "source"])
    return d.select("doc_id", F.concat(F.lit("/data/"), F.col("source"), F.lit("/"),
                                       _name(F.col("doc_id"))).alias("path"))


def present_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) - the files a listing found: those of the documents in ``labels``."""
    m = file_manifest(spark, sf_dir)
    lab = read(spark, sf_dir, "labels", ["doc_id"])
    return m.join(lab, "doc_id", "left_semi").select("path")


PROVIDER_CHOICES = ["deepseek", "OpenAI", "anthropic", "gemini", "openrouter", "mistral", "Gemini"]
# the caller's alias list for the aliased queries
ALIASES = [("mistral", "openrouter"), ("gpt", "openai")]
MODEL_CHOICES = ["", "openai/gpt-4o-mini", "custom-model", ""]


def model_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, provider, model) - a requested provider/model per document."""
    d = read(spark, sf_dir, "documents", ["doc_id"])
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]),
                                      (F.pmod(F.col("doc_id"), F.lit(m)) + 1).cast("int"))
    return d.select("doc_id", pick(PROVIDER_CHOICES, 7).alias("provider"),
                    pick(MODEL_CHOICES, 4).alias("model"))


REPLY_STYLES = ["choices", "choices", "content_blocks", "choices_or_empty", "text_only", "text_only"]


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reply_style, body) - a service reply per document carrying the
    whole document text, in one of the reply shapes (incl. a reply without
    usage, a NULL content and an empty reply)."""
    d = read(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    k = F.pmod(F.col("doc_id"), F.lit(len(REPLY_STYLES))).cast("int")
    p = F.col("n_chars")
    c = F.col("doc_id") + 1
    usage_pc = F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    null_choice = F.struct(F.struct(F.lit(None).cast("string").alias("content")).alias("message"))
    bodies = [
        F.to_json(F.struct(F.array(choice).alias("choices"), usage_pc.alias("usage"))),
        F.to_json(F.struct(F.array(choice).alias("choices"))),
        F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
                           F.struct(p.alias("input_tokens"), c.alias("output_tokens")).alias("usage"))),
        F.to_json(F.struct(F.array(null_choice).alias("choices"),
                           F.struct(p.alias("prompt_tokens"), F.lit(0).alias("completion_tokens")).alias("usage"))),
        F.to_json(F.struct(F.col("text").alias("text"))),
        F.lit("{}"),
    ]
    body = F.element_at(F.array(*bodies), k + 1)
    style = F.element_at(F.array(*[F.lit(s) for s in REPLY_STYLES]), k + 1)
    return d.select("doc_id", style.alias("reply_style"), body.alias("body"))


def cached_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, reply_style, body) - a reply per document whose usage says what came from the provider's
    cache, in the shape of one provider or another, or says nothing of it."""
    d = read(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    k = F.pmod(F.col("doc_id"), F.lit(4))
    p, c = F.col("n_chars"), F.col("doc_id") + 1
    hit = F.floor(p * F.pmod(F.col("doc_id"), F.lit(5)) / 4)
    choices = F.array(F.struct(F.struct(F.lit("text").alias("content")).alias("message"))).alias("choices")
    usages = [
        F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), hit.alias("prompt_cache_hit_tokens"), (p - hit).alias("prompt_cache_miss_tokens")),
        F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), F.struct(hit.alias("cached_tokens")).alias("prompt_tokens_details"),
                 F.struct((c * 2).alias("reasoning_tokens")).alias("completion_tokens_details")),
        F.struct((p - hit).alias("input_tokens"), c.alias("output_tokens"), hit.alias("cache_read_input_tokens"), F.lit(7).alias("cache_creation_input_tokens")),
        F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens")),
    ]
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.lit("text").alias("text"))).alias("content")
    bodies = [F.to_json(F.struct(blocks if n == 2 else choices, u.alias("usage"))) for n, u in enumerate(usages)]
    body = F.element_at(F.array(*bodies), (k + 1).cast("int"))
    models = F.array(*[F.lit(m) for m in COST_MODELS[1:]])
    return d.select("doc_id", F.element_at(models, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("model"),
                    F.when(k == 2, "content_blocks").otherwise("choices").alias("reply_style"), body.alias("body"))


def named_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, piece) - every document as a text file of its own, named by its id and a suffix, in order of names."""
    shapes = F.array(*[F.lit(suffix) for _, suffix in NAME_SHAPES])
    suffix = F.element_at(shapes, (F.pmod("doc_id", F.lit(len(NAME_SHAPES))) + 1).cast("int"))
    rows = documents(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix).alias("name"), F.coalesce("text", F.lit("")).alias("piece"))
    return rows.repartitionByRange("name").sortWithinPartitions("name")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, piece) - one file per source: its documents by id, with a page marker at every line end and after
    every document. The largest source's file holds a large share of all text."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(PAGE_SUFFIX))
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit(".txt"))
    rows = documents(spark, sf_dir).select(name.alias("name"), "doc_id", F.concat(text, F.lit(PAGE_SUFFIX)).alias("piece"))
    return rows.repartitionByRange("name", "doc_id").sortWithinPartitions("name", "doc_id").select("name", "piece")


# Target language and provider per source language (a routing table; other languages have no route).
ROUTES = [("en", "pt", "deepseek"), ("fr", "en", "OpenAI"), ("de", "en", "anthropic"), ("es", "en", "gemini")]


def routes(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ROUTES, "lang string, target_lang string, provider string"))


def routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, target_lang, provider, model) - documents with the route of their language, and for
    every third one the provider and model that ``model_specs`` asks for. Every seventh document comes once
    more under the id -1 - doc_id, in a language without a route."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang")
    d = d.union(d.where(F.pmod("doc_id", F.lit(7)) == 0).select(-1 - F.col("doc_id"), "text", F.lit("xx")))
    d = d.join(routes(spark), "lang", "left")
    own = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]),
                                      (F.pmod(F.col("doc_id"), F.lit(m)) + 1).cast("int"))
    return d.select("doc_id", "text", "target_lang",
                    F.when(own & F.col("provider").isNotNull(), pick(PROVIDER_CHOICES, 7)).otherwise(F.col("provider")).alias("provider"),
                    F.when(own, pick(MODEL_CHOICES, 4)).otherwise("").alias("model"))


COST_MODELS = ["deepseek-chat", "deepseek-reasoner", "deepseek-chat", "unknown-model"]
COST_CACHES = ["miss", "hit", "other"]


def cost_specs(usage: DataFrame) -> DataFrame:
    """Adds (model, cache) per usage row: the priced models, an unknown model
    and an invalid cache value, picked by doc_id."""
    models, caches = COST_MODELS, COST_CACHES
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]),
                                   (F.pmod(F.col("doc_id"), F.lit(len(xs))) + 1).cast("int"))
    return usage.select("*", pick(models).alias("model"), pick(caches).alias("cache"))


# --- offline services ------------------------------------------------------------

def failures_by_key(bad: Callable[[str], bool], calls: int = dims.MAX_ATTEMPTS) -> Callable[[str], int]:
    """Failure script: texts for which ``bad`` holds fail ``calls`` times."""
    def rule(text: str) -> int:
        return calls if bad(text) else 0
    return rule


class EchoService:
    """Offline stand-in: answers ``[lang] text``; usage in the given key style."""

    def __init__(self, usage_style: str = "prompt_completion"):
        self.usage_style = usage_style

    def __call__(self, text: str, lang: str) -> tuple:
        out = f"[{lang}] {text}"
        p = py_approx_tokens(py_user_message(text, lang))
        c = py_approx_tokens(out)
        if self.usage_style == "input_output":
            return out, {"input_tokens": p, "output_tokens": c}
        if self.usage_style == "none":
            return out, {}
        return out, {"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c}


class FlakyService:
    """Fails the first ``failures(text)`` attempts for a text, then answers like ``base``."""

    def __init__(self, base: Callable, failures: Callable[[str], int]):
        self.base, self.failures = base, failures

    def attempt(self, number: int) -> Callable:
        """The service as it is at a text's attempt ``number`` (from 1)."""
        def call(text: str, lang: str) -> tuple:
            if number <= self.failures(text):
                raise RuntimeError(f"service unavailable (failing call {number})")
            return self.base(text, lang)
        return call

    def __call__(self, text: str, lang: str) -> tuple:
        return self.attempt(1)(text, lang)


def paragraphs(content: bytes) -> list[str]:
    """Decoder of the hook's query: the text between paragraph tags, a page each."""
    return content.decode().split("<p>")


def head_and_title(content: bytes) -> list[str]:
    """Decoder of the hook's query: a text with a short preface, as it is."""
    return ["decoded: ", content.decode()]


def failures_by_length(modulus: int = 4) -> Callable[[str], int]:
    """Failure script used by the registered failure query: len(text) mod m."""
    def rule(text: str) -> int:
        return len(text) % modulus
    return rule


class EchoTransport:
    """Offline stand-in for the providers' endpoints, for ``send_requests``:
    reads the request body and answers ``[lang] text`` in the provider's reply
    shape, with usage from the ceil(len/4) estimate (none for text-only replies)."""

    def __call__(self, provider: str, body: str) -> str:
        req = json.loads(body)
        user = req["contents"] if "contents" in req else req["messages"][-1]["content"]
        head, text = user.split("\n", 1)
        lang = head[len("Translate to "):-1]
        out = f"[{lang}] {text}"
        p, c = py_approx_tokens(user), py_approx_tokens(out)
        style = _STYLES[provider][1]
        if style == "content_blocks":
            return json.dumps({"content": [{"type": "text", "text": out}],
                               "usage": {"input_tokens": p, "output_tokens": c}})
        if style == "text_only":
            return json.dumps({"text": out})
        return json.dumps({"choices": [{"message": {"content": out}}],
                           "usage": {"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c}})
