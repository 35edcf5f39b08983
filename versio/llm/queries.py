"""The registered queries of the operators: each applies one operator to its
whole table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.llm import bpe, byte_bpe, cdc_dedup, chat, exact_dedup, knn, langid, mixing, periodic, repair, simhash, toxicity, warc
from versio.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: 3-word shingles, at most 2 bits."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that documents with smaller ids hold."""
    return cdc_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document and whether it is toxic."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best neighbours of every twentieth vector."""
    return knn.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20, F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated so that a source's expected share is that of the square root of its size."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.replicate(docs, power=0.5, seed=42)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal text but for white space; every text's digest is carried along
    for this report."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return exact_dedup.exact_duplicates(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def vocabulary() -> str:
    """Place of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of their decoded text."""
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def arc_of_pages(pages: DataFrame) -> DataFrame:
    """The pages as ARC records: an HTTP response that names the page, dated by its number."""
    html = F.coalesce("html", F.lit(""))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), number, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    when = F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000)))
    return pages.select(F.coalesce("url", F.concat(F.lit("urn:page:"), number)).alias("url"), F.date_format(when, "yyyyMMddHHmmss").alias("date"), F.lit("text/html").alias("mime"), F.concat(head, html).alias("block"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC and read back."""
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(arc_of_pages(_table(spark, sf_dir, "pages")), arc)
    warc.convert(spark, arc, out, key_header="X-Page-Id")
    back = warc.read_warc(spark, out).where(F.col("type").isin("response", "revisit"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").alias("refers_to"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by models that never saw a fifth of them."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=("held_out",))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted, then read back from the formatted text."""
    own = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(own))
    done = chat.format_conversations(turns.union(added)).select("conv_id", "formatted", "valid")
    back = done.withColumn("turns", chat.read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by a hash of its id goes on from some word with the words from there
    over and over. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    root = F.slice("words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    planted = F.array_join(F.concat(F.slice(F.col("words"), F.lit(1), a), tail), " ")
    return words.select("doc_id", F.when(F.coalesce(n, F.lit(0)) > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, planted ones included, and digests of what is left."""
    found = periodic.periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    facts = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), periodic.best_run(F.col("runs")).alias("best"),
                         F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return facts.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults made by a hash of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, the cheapest repair and a digest of the repaired turns."""
    turns = _table(spark, sf_dir, "conversations")
    summary, standing = repair.repair_conversations(damaged_turns(turns))
    lines = standing.select("conv_id", "number", F.concat_ws(":", "role", "text").alias("line"))
    digests = repair.digest_lines(lines, "conv_id", "number", "line", "repaired_sha256").withColumnRenamed("conv_id", "digest_id")
    found = summary.withColumnRenamed("conv_id", "found_id")
    every = turns.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")) & F.col("audit").isNotNull(), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("digest_id")) & F.col("repaired_sha256").isNotNull(), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select("conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-level ids of every document and of their decoded bytes."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), *file)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    decoded = byte_bpe.decode(encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), *file, keep=("n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash, op2_substring_dedup, op3_toxicity, op4_knn, op5_mixing, op6_exact_dedup, op7_bpe, op8_warc, op9_langid, op10_chat,
    op11_periodic_runs, op12_repair, op13_byte_bpe)}
