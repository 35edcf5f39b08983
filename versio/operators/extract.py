"""Extraction candidates and the choice of the best one.

The reference runs three extractors on one file and keeps the longest text
(stripped length; ties go to the earlier method). Here:

* ``html_candidates`` - three built-in extractors over an HTML column, all
  computed in one projection of the scan (no union, no second scan):
  ``native`` (priority 1): visible text, one page per stretch ended by a
  closing nav/div/article/footer/section/header tag or an ``<hr>``, each page
  stripped and followed by the page marker;
  ``article`` (priority 2): the ``<article>`` blocks only, a marked page each;
  ``markdown`` (priority 3): headings, links and list items as Markdown,
  whole document, not stripped, no markers.
* ``best_in_row`` picks the winner with array functions on the same row, so
  choosing needs no exchange; ``choose_best`` does the same for a long
  candidates table (any source) with one ``max_by`` aggregation.
* ``extract_binary`` is the hook for binary files: caller-supplied Python
  decoders run in ``mapInPandas`` and emit one candidate row per document and
  method (pages marked in order); an error keeps the pages read so far
  (partial text) and records the message.
* ``mark_pages`` (B5) joins page rows into one marked text with an ordered
  ``listagg``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.functions.text import PAGE_SUFFIX, col_of, is_blank, strip
from versio.session import written

METHODS = (("native", 1), ("article", 2), ("markdown", 3))

# tag patterns name the tag exactly: "<p" must not match <pre> or <param>; tags have any case. In the rest of a
# tag a quoted value after an equals sign may hold ">".
_REST = r"[^>=]*(?:=\s*(?:\"[^\"]*\"|'[^']*')?[^>=]*)*"
_ATTRS = rf"(?:\s{_REST})?"
_TAG = rf"(?i)</?[a-z]{_REST}>|<[!?][^>]*>"
_BLOCK_END = rf"(?i)</nav\s*>|</div\s*>|</article\s*>|</footer\s*>|</section\s*>|</header\s*>|<hr{_ATTRS}/?>"
_LINE_BREAK = rf"(?i)<br{_ATTRS}/?>|</p\s*>|</h[1-6]\s*>|</li\s*>|<p{_ATTRS}>"
_H1 = rf"(?is)<h1{_ATTRS}>(.*?)</h1\s*>"
_H2 = rf"(?is)<h2{_ATTRS}>(.*?)</h2\s*>"
_LINK = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)){_REST}>(.*?)</a\s*>"
_LI = rf"(?i)<li{_ATTRS}>"
_NOISE = rf"(?is)<script{_ATTRS}>.*?</script\s*>|<style{_ATTRS}>.*?</style\s*>|<!--.*?-->"
_BODY = rf"(?is)<body{_ATTRS}>(.*)</body\s*>"
_ARTICLE = rf"(?is)<article{_ATTRS}>(.*?)</article\s*>"


def _code_point(digits: Column, base: int) -> Column:
    """The character of a code point written in ``base``; NULL when there is none."""
    n = F.conv(digits, base, 10).cast("bigint")
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


#: Names that most references have.
COMMON = ("copy", "middot", "nbsp", "quot", "gt", "lt", "amp")


def named_entities() -> dict[str, dict[str, str]]:
    """The named character references of HTML (those that end in a semicolon, without it), by first letter."""
    table: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        if name.endswith(";"):
            table.setdefault(name[0], {})[name[:-1]] = chars
    return table


def _named(name: Column) -> Column:
    """The characters of a named reference; NULL if there is none of that name. A literal of two levels, so that
    few names are compared."""
    # one literal for the optimizer to fold, rather than thousands
    table = F.from_json(F.lit(json.dumps(named_entities(), ensure_ascii=True)), "map<string, map<string, string>>")
    found = F.try_element_at(F.try_element_at(table, F.left(name, F.lit(1))), name)
    for common in COMMON:  # compared before the table is searched
        found = F.when(name == common, F.lit(html5[f"{common};"])).otherwise(found)
    return found


def decode_entities(c) -> Column:
    """Character references to their characters, each once: ``&#65;``, ``&#x41;`` and the named ones. A reference to
    no character, or one without its semicolon, stays as it is."""
    def char(name: Column) -> Column:
        dec, hexa = F.regexp_extract(name, "^#([0-9]{1,7})$", 1), F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,6})$", 1)
        number = F.when(dec != "", _code_point(dec, 10)).when(hexa != "", _code_point(hexa, 16))
        return F.when(F.startswith(name, F.lit("#")), number).otherwise(_named(name))

    def piece(x: Column) -> Column:
        found = F.transform(F.array(F.regexp_extract(x, "^(#?[a-zA-Z0-9]{1,40});", 1)), char)[0]
        return F.transform(F.array(found), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), x)).otherwise(
            F.concat(c, F.substring(x, F.locate(";", x) + 1, F.length(x)))))[0]

    def whole(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
        return F.when(F.contains(t, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(t)

    # as a lambda's argument the text is computed once, however often it is used
    return F.transform(F.array(col_of(c)), whole)[0]


def body_of(html) -> Column:
    body = F.regexp_extract(col_of(html), _BODY, 1)
    inner = F.when(body == "", col_of(html)).otherwise(body)
    return F.regexp_replace(inner, _NOISE, "")


def visible_text(fragment) -> Column:
    """Tags to line breaks (block ends) or nothing (inline), entities decoded."""
    broken = F.regexp_replace(col_of(fragment), _LINE_BREAK, "\n")
    return decode_entities(F.regexp_replace(broken, _TAG, ""))


def marked(pages: Column) -> Column:
    """B5 on an in-row page array: strip(page) + marker, concatenated in order."""
    return F.array_join(F.transform(pages, lambda p: F.concat(strip(p), F.lit(PAGE_SUFFIX))), "")


def native_text(body) -> Column:
    blocks = F.split(col_of(body), _BLOCK_END, -1)
    # the text after the last block end is a page too (it may be blank)
    return marked(F.transform(blocks, visible_text))


def article_text(body) -> Column:
    found = F.regexp_extract_all(col_of(body), F.lit(_ARTICLE), F.lit(1))
    # without an article there is one empty page, without a body (NULL) none
    articles = F.when(F.size(found) > 0, found).when(found.isNotNull(), F.array(F.lit("")))
    return marked(F.transform(articles, visible_text))


def markdown_text(body) -> Column:
    x = col_of(body)
    x = F.regexp_replace(x, _H1, "\n# $1\n")
    x = F.regexp_replace(x, _H2, "\n## $1\n")
    x = F.regexp_replace(x, _LINK, "[$4]($1$2$3)")
    x = F.regexp_replace(x, _LI, "\n- ")
    return visible_text(x)


_EXTRACTORS = {"native": native_text, "article": article_text, "markdown": markdown_text}


def _candidate_array(body: str, methods=METHODS) -> Column:
    """All extractors over the cleaned body (computed once, in its own projection)."""
    return F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(p).alias("priority"),
                 _EXTRACTORS[m](body).alias("text"), F.lit(None).cast("string").alias("error"))
        for m, p in methods
    ])


def _bodies(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(F.col(key).alias("doc_id"), body_of(html).alias("__body"))


def html_candidates(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """candidates(doc_id, method, priority, text, error, chosen), one scan.

    ``chosen`` marks the candidate B6 picks, decided on the same row, so
    per-method statistics need no second extraction pass and no join."""
    arr = _bodies(pages, key, html).select("doc_id", _candidate_array("__body").alias("__c"))
    best = arr.select("doc_id", "__c", best_in_row(F.col("__c"))["method"].alias("__best"))
    # the outer form: for a plain ``inline`` the optimizer adds a size filter that runs all extractors again
    return best.select("doc_id", F.inline_outer("__c"), "__best").select(
        "doc_id", "method", "priority", "text", "error", (F.col("method") == F.col("__best")).alias("chosen"))


def _scored(cands: Column) -> Column:
    """Candidates as (n = stripped length, neg_priority, method, text) so the
    natural struct order is the choice order: longest first, then the earlier method."""
    return F.transform(cands, lambda c: F.struct(
        F.length(strip(c["text"])).alias("n"), (-c["priority"]).alias("neg_priority"),
        c["method"].alias("method"), c["text"].alias("text")))


def best_in_row(cands: Column) -> Column:
    """B6 on an in-row candidate array: ``array_max`` by (stripped length, -priority)."""
    return F.array_max(_scored(cands))


def _with_status(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "status", F.when(F.coalesce(is_blank("text"), F.lit(True)), F.lit("empty_extraction")).otherwise(F.lit("ok"))
    )


def html_best(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """B6 + B7: extracted(doc_id, method, text, status) without any exchange."""
    chosen = _bodies(pages, key, html).select("doc_id", best_in_row(_candidate_array("__body")).alias("__b"))
    out = chosen.select("doc_id", F.col("__b.method").alias("method"), F.col("__b.text").alias("text"))
    return _with_status(out)


def choose_best(candidates: DataFrame) -> DataFrame:
    """B6 + B7 for a long candidates table from any source: one ``max_by``
    aggregation per document (partial aggregation before the exchange)."""
    win = F.max_by(F.struct("method", "text"), F.struct(F.length(strip("text")), -F.col("priority")))
    out = candidates.groupBy("doc_id").agg(win.alias("w")).select(
        "doc_id", F.col("w.method").alias("method"), F.col("w.text").alias("text"))
    return _with_status(out)


#: Rows of the table of winners' bits that are broadcast at most (a path, a number and 64 bits each); each stands for
#: 64 rows of candidates.
BROADCAST_WORDS = 500_000


def choose_best_stored(spark: SparkSession, path: str) -> DataFrame:
    """B6 + B7 for candidates stored as Parquet at ``path``, without moving their texts: only lengths and row
    locators (file and row number) are shuffled, the winners of each file are told to a second scan as bits, and
    the scan keeps their rows where they lie. A table of bits that is too long to broadcast is joined by file and
    place instead. Result and ties as ``choose_best``; rows of equal length and priority go by their place."""
    rows = spark.read.parquet(path).select("doc_id", "method", "priority", "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    score = F.struct(F.length(strip("text")).alias("n"), (-F.col("priority")).alias("p"), "__file", (-F.col("__row")).alias("r"))
    winners = rows.select("doc_id", score.alias("score")).groupBy("doc_id").agg(F.max("score").alias("best"))
    place = winners.select(F.col("best.__file").alias("__f"), (-F.col("best.r")).alias("__at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("__at", F.lit(64)).cast("int"))
    words = written(place.groupBy("__f", F.floor(F.col("__at") / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits")), "winners")
    told = F.broadcast(words) if words.count() <= BROADCAST_WORDS else words
    held = F.call_function("shiftright", F.col("__bits"), F.pmod("__row", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined = rows.join(told, (F.col("__file") == F.col("__f")) & (F.floor(F.col("__row") / 64) == F.col("__word")))
    return _with_status(joined.where(held).select("doc_id", "method", "text"))


def extraction_stats(candidates: DataFrame) -> DataFrame:
    """Per method, candidate count, characters (raw and stripped), and how
    often and with how many characters it was chosen (``chosen`` flag of
    ``html_candidates``, or ``flag_chosen`` for any long table). One
    aggregation on a handful of keys, partially aggregated in every task."""
    chosen = F.col("chosen")
    return candidates.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.sum(F.length(strip("text"))).cast("bigint").alias("stripped_chars"),
        F.count_if(chosen).alias("n_chosen"),
        F.coalesce(F.sum(F.when(chosen, F.length("text"))), F.lit(0)).cast("bigint").alias("chosen_chars"),
    )


def flag_chosen(candidates: DataFrame) -> DataFrame:
    """Adds ``chosen`` to a long candidates table: one ``max_by`` per document
    joined back on (doc_id, method), both sides keyed by doc_id."""
    best = choose_best(candidates).select("doc_id", F.col("method").alias("__best"))
    return (candidates.join(best, "doc_id", "left")
            .withColumn("chosen", F.col("method") == F.col("__best")).drop("__best"))


def mark_pages(page_rows: DataFrame, *, key: str = "doc_id", order: str = "page_no",
               text: str = "text") -> DataFrame:
    """Rows (key, page_no, text) -> (key, text) with every page stripped and
    followed by the marker, in page order (empty pages kept). One aggregation
    by key; ``listagg ... WITHIN GROUP`` keeps the page order."""
    return (
        page_rows.select(key, order, F.concat(strip(text), F.lit(PAGE_SUFFIX)).alias("__m"))
        .groupBy(key)
        .agg(F.expr(f"listagg(__m, '') WITHIN GROUP (ORDER BY {order})").alias("text"))
    )


# --- binary hook -------------------------------------------------------------

@dataclass(frozen=True)
class PyExtractor:
    """A caller-supplied decoder: ``pages(content: bytes) -> iterable of page texts``.

    ``paged`` extractors get the marker after every stripped page; a non-paged
    one yields a single text used as is (not stripped, no marker)."""
    method: str
    priority: int
    pages: Callable[[bytes], Sequence[str]]
    paged: bool = True


def extract_binary(files: DataFrame, extractors: Sequence[PyExtractor], *, key: str = "doc_id",
                   content: str = "content", long: bool = True) -> DataFrame:
    """B1-B4 for binary documents -> candidates(doc_id, method, priority, text, error), or with
    ``long=False`` one row (doc_id, candidates ARRAY<STRUCT>) per document, from which
    ``binary_best`` chooses without an exchange. NULL content has no pages."""
    exs = list(extractors)
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, blob in zip(pdf[key], pdf[content]):
                cands = []
                for ex in exs:
                    parts, err = [], None
                    try:
                        for page in ex.pages(bytes(blob)) if blob is not None else ():
                            parts.append(page)
                    except Exception as exc:  # keep the partial text
                        err = f"{type(exc).__name__}: {exc}"
                    if ex.paged:
                        text = "".join(p.strip() + PAGE_SUFFIX for p in parts)
                    else:
                        text = "" if err else "".join(parts)
                    cands.append({"method": ex.method, "priority": ex.priority, "text": text, "error": err})
                rows.append((k, cands))
            yield pd.DataFrame(rows, columns=["doc_id", "candidates"])

    schema = (f"doc_id {types[key]}, "
              "candidates array<struct<method: string, priority: int, text: string, error: string>>")
    found = files.select(key, content).mapInPandas(run, schema)
    return found.select("doc_id", F.inline_outer("candidates")).where(F.col("method").isNotNull()) if long else found


def binary_best(files: DataFrame, extractors: Sequence[PyExtractor], *, key: str = "doc_id",
                content: str = "content") -> DataFrame:
    """B6 + B7 for binary documents: extracted(doc_id, method, text, status), chosen in the row."""
    found = extract_binary(files, extractors, key=key, content=content, long=False)
    best = found.select("doc_id", best_in_row(F.col("candidates")).alias("__b"))
    return _with_status(best.select("doc_id", F.col("__b.method").alias("method"), F.col("__b.text").alias("text")))
