"""Small lookup dimensions (A5, M10-M13): prices, default and known models,
provider styles, provider aliases.

Every table here is a fixed handful of rows, so broadcasting it is safe: its
size does not grow with the data; ``_dim`` still checks the row bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (they must equal the reference's for equal results) -------

# USD per 1M tokens: (model, cache, input, output).
PRICES = [
    ("deepseek-chat", "hit", 0.07, 1.10),
    ("deepseek-chat", "miss", 0.14, 1.10),
    ("deepseek-reasoner", "hit", 0.14, 2.19),
    ("deepseek-reasoner", "miss", 0.55, 2.19),
]

# Model used when the caller gives none.
DEFAULT_MODELS = [
    ("openrouter", "google/gemini-2.0-pro-exp-02-05:free"),
    ("deepseek", "deepseek-chat"),
    ("anthropic", "claude-3-5-haiku-20241022"),
    ("openai", "gpt-4o-mini"),
    ("gemini", "gemini-2.0-flash"),
]

# Models the openrouter provider knows; any other model only gives a warning flag.
OPENROUTER_MODELS = [
    "cognitivecomputations/dolphin3.0-r1-mistral-24b:free",
    "cognitivecomputations/dolphin3.0-mistral-24b:free",
    "openai/chatgpt-4o-latest",
    "openai/gpt-4o-mini",
    "google/gemini-2.0-flash-001",
    "google/gemini-2.0-flash-thinking-exp:free",
    "google/gemini-2.0-flash-lite-preview-02-05:free",
    "google/gemini-2.0-pro-exp-02-05:free",
    "deepseek/deepseek-r1-distill-llama-70b:free",
    "deepseek/deepseek-r1-distill-qwen-32b",
    "deepseek/deepseek-r1:free",
    "qwen/qwen-plus",
    "qwen/qwen-max",
    "qwen/qwen-turbo",
    "qwen/qwen2.5-vl-72b-instruct:free",
    "mistralai/codestral-2501",
    "mistralai/mistral-7b-instruct:free",
    "mistralai/mistral-small-24b-instruct-2501:free",
    "anthropic/claude-3.5-haiku-20241022:beta",
    "anthropic/claude-3.5-sonnet",
    "perplexity/sonar-reasoning",
    "perplexity/sonar",
    "perplexity/llama-3.1-sonar-large-128k-online",
    "perplexity/llama-3.1-sonar-small-128k-chat",
    "nvidia/llama-3.1-nemotron-70b-instruct:free",
    "microsoft/phi-3-medium-128k-instruct:free",
    "meta-llama/llama-3.3-70b-instruct:free",
]

# Provider -> (request style, reply style). Request styles: "chat" = system and
# user messages; "system_field" = system as a top-level field; "config" =
# system inside a generation config. Reply styles name the JSON shape.
PROVIDERS = [
    ("deepseek", "chat", "choices"),
    ("anthropic", "system_field", "content_blocks"),
    ("openai", "chat", "choices_or_empty"),
    ("gemini", "config", "text_only"),
    ("openrouter", "chat", "choices_or_empty"),
]

# Optional provider aliases of the command-line front end (off by default).
CLI_ALIASES = [("openrouter", "gemini")]

# Request constants shared by all providers.
TEMPERATURE = 0.0
MAX_OUTPUT_TOKENS = 8000
REQUEST_TIMEOUT_S = 60
MAX_ATTEMPTS = 3
WAIT_MULTIPLIER = 1.0
WAIT_MIN_S = 4.0
WAIT_MAX_S = 10.0
DEFAULT_CONCURRENCY = 4
SUPPORTED_FORMATS = (".pdf", ".doc", ".docx", ".odt")
# -----------------------------------------------------------------------------

# Our own system instruction (wording is ours; the intent - translate
# faithfully, keep layout, leave references, identifiers, URLs/DOIs and math
# untouched - is the reference's).
SYSTEM_PROMPT = (
    "Translate the user's academic or technical text into the requested language. "
    "Keep the layout: headings, lists, tables, line breaks and Markdown as they are. "
    "Do not translate and do not alter: bibliographic references and citations, "
    "names of people, institutions, journals, software and datasets, URLs and DOIs, "
    "code and identifiers, units and standard abbreviations, and any mathematics "
    "(LaTeX, inline $...$ or display $$...$$ blocks, equations, Greek letters). "
    "Answer with the translation only."
)

MAX_BROADCAST_ROWS = 10_000


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def _dim(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A dimension from driver-side literal rows, broadcast when its (known)
    row count is within the bound; beyond it the planner picks the join.

    The rows are an inline ``VALUES`` table, i.e. a local relation in the
    plan: broadcasting it runs no job of its own."""
    rows = list(rows)
    fields = [f.strip().split() for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(n for n, _ in fields)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    df = df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def pricing(spark: SparkSession) -> DataFrame:
    return _dim(spark, PRICES, "model string, cache string, input_per_m double, output_per_m double")


def cache_prices(spark: SparkSession) -> DataFrame:
    """A row per model: the prices of cached and other input tokens, and of output tokens."""
    by_model = {}
    for model, cache, price, output in PRICES:
        by_model.setdefault(model, {})[cache] = (price, output)
    rows = [(m, p["hit"][0], p["miss"][0], p["miss"][1]) for m, p in by_model.items()]
    return _dim(spark, rows, "model string, hit_per_m double, miss_per_m double, output_per_m double")


def default_models(spark: SparkSession) -> DataFrame:
    return _dim(spark, DEFAULT_MODELS, "provider string, default_model string")


def known_models(spark: SparkSession) -> DataFrame:
    return _dim(spark, [("openrouter", m) for m in OPENROUTER_MODELS], "provider string, model string")


def providers(spark: SparkSession) -> DataFrame:
    return _dim(spark, PROVIDERS, "provider string, request_style string, reply_style string")


def aliases(spark: SparkSession, pairs=None) -> DataFrame:
    return _dim(spark, list(pairs if pairs is not None else CLI_ALIASES), "alias string, provider string")
