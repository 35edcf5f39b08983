"""DuckDB SQL twins of the registered queries (the correctness oracle).

They run on the driver's pre-registered views. Pieces are composed from
small CTE builders so each stage is stated once. Dialect notes (DuckDB):
``regexp_replace`` needs the 'g' flag, RE2 writes \\x{85} for U+0085,
``string_agg`` needs a constant separator, ``ceil`` returns DOUBLE.
"""

from __future__ import annotations

from versio.functions.text import WS_CLASS_RE2

WS = WS_CLASS_RE2
MARK = "<<<PAGE_BREAK>>>"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda x: x <> '')"


def tokens(expr: str) -> str:
    return f"CAST(ceil(length({expr}) / 4.0) AS BIGINT)"


def split_pages_cte(source: str, text: str = "text", key: str = "doc_id") -> str:
    """pg(doc_id, page_idx, page): stripped non-blank pages, dense 0-based index."""
    kept = f"list_filter(list_transform(string_split({text}, '{MARK}'), lambda p: {strip("p")}), lambda p: p <> '')"
    return f"""pg_l AS (SELECT {key} AS doc_id, {kept} AS ps FROM {source}),
pg AS (
  SELECT doc_id, CAST(unnest(range(0, len(ps))) AS INTEGER) AS page_idx, unnest(ps) AS page
  FROM pg_l
)"""


def chunks_cte(limit: int, pages: str = "pg") -> str:
    """ck(doc_id, page_idx, chunk_idx, chunk) from pages(doc_id, page_idx, page).

    Runs: a long line (estimate >= limit) alone, or the short lines between
    long lines. A recursive CTE walks each run's cost list and numbers the
    greedy bins; a word run whose first cost passes the limit opens an empty bin.
    """
    L = int(limit)
    return f"""ln_l AS (SELECT doc_id, page_idx, string_split(page, chr(10)) AS ls FROM {pages}),
ln AS (
  SELECT doc_id, page_idx, unnest(range(1, len(ls) + 1)) AS li, unnest(ls) AS line FROM ln_l
),
ln_t AS (SELECT *, {tokens('line')} AS t FROM ln),
ln_r AS (
  SELECT *, CASE WHEN t >= {L} THEN 2 * li
            ELSE 2 * coalesce(max(CASE WHEN t >= {L} THEN li END) OVER (
                   PARTITION BY doc_id, page_idx ORDER BY li
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 END AS rk
  FROM ln_t
),
wd_l AS (SELECT doc_id, page_idx, rk, {words('line')} AS ws FROM ln_r WHERE t >= {L}),
atom AS (
  SELECT doc_id, page_idx, rk, false AS w, li AS k, line AS a, t AS c FROM ln_r WHERE t < {L}
  UNION ALL
  SELECT doc_id, page_idx, rk, true AS w, k, a, CAST(ceil((length(a) + 1) / 4.0) AS BIGINT) AS c
  FROM (SELECT doc_id, page_idx, rk, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS a FROM wd_l)
),
atom_n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, rk ORDER BY k) AS pos FROM atom
),
run AS (
  SELECT doc_id, page_idx, rk, list(c ORDER BY pos) AS cs FROM atom_n GROUP BY doc_id, page_idx, rk
),
fold AS (
  SELECT doc_id, page_idx, rk, cs, 1 AS pos,
         CASE WHEN cs[1] > {L} THEN 1 ELSE 0 END AS bin, cs[1] AS used
  FROM run
  UNION ALL
  SELECT doc_id, page_idx, rk, cs, pos + 1,
         CASE WHEN used + cs[pos + 1] > {L} THEN bin + 1 ELSE bin END,
         CASE WHEN used + cs[pos + 1] > {L} THEN cs[pos + 1] ELSE used + cs[pos + 1] END
  FROM fold WHERE pos < len(cs)
),
binned AS (
  SELECT a.doc_id, a.page_idx, a.rk, f.bin, a.w, a.pos, a.a
  FROM atom_n a JOIN fold f
    ON a.doc_id = f.doc_id AND a.page_idx = f.page_idx AND a.rk = f.rk AND a.pos = f.pos
),
bins AS (
  SELECT doc_id, page_idx, rk, bin,
         CASE WHEN bool_or(w) THEN string_agg(a, ' ' ORDER BY pos)
              ELSE string_agg(a, chr(10) ORDER BY pos) END AS chunk
  FROM binned GROUP BY doc_id, page_idx, rk, bin
  UNION ALL
  SELECT doc_id, page_idx, rk, 0 AS bin, '' AS chunk FROM run WHERE cs[1] > {L}
),
ck AS (
  SELECT doc_id, page_idx,
         CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY rk, bin) - 1 AS INTEGER) AS chunk_idx,
         chunk
  FROM bins
)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# --- shared pieces -------------------------------------------------------------

NL = "chr(10)"
SUFFIX_SQL = f"{NL} || '{MARK}' || {NL}"


def lit_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def pick(xs, key: str = "doc_id") -> str:
    """xs[key mod n] (DuckDB lists are 1-based)."""
    return f"{lit_list(xs)}[{key} % {len(xs)} + 1]"


def is_blank(expr: str) -> str:
    return f"NOT regexp_matches({expr}, '[^{WS[1:-1]}]')"


def kept_pages(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, '{MARK}'), lambda p: {strip('p')}), lambda p: p <> '')"


def conv_marked_cte() -> str:
    return f"""cm AS (
  SELECT conv_id AS doc_id,
         string_agg({strip('text')} || {SUFFIX_SQL}, '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
)"""


def marked_cte(name: str = "md") -> str:
    return f"{name} AS (SELECT doc_id, replace(text, {NL}, {SUFFIX_SQL}) AS text FROM documents)"


def uneven_cte(name: str = "ud") -> str:
    return f"""{name} AS (
  SELECT doc_id, text FROM documents
  UNION ALL
  SELECT -1 - doc_id, CASE doc_id % 9 WHEN 1 THEN ' ' || {NL} || chr(9) WHEN 2 THEN {SUFFIX_SQL} || {SUFFIX_SQL} WHEN 3 THEN '' END
  FROM documents WHERE doc_id % 9 < 4
)"""


def edge_cte(name: str = "ed") -> str:
    return f"""{name} AS (
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN replace(text, {NL}, {NL} || {NL} || ' ' || {NL} || {NL})
    WHEN 1 THEN replace(replace(text, ' ', chr(9)), {NL}, chr(160) || {NL})
    WHEN 2 THEN replace(text, ' ', '')
    ELSE {NL} || {NL} || chr(8195) || replace(text, ' ', chr(160) || ' ') || {NL} || ' ' || {NL} END AS text
  FROM documents
)"""


def echo_cte(source: str = "ck", lang: str = "pt", name: str = "tr") -> str:
    user = f"'Translate to {lang}:' || {NL} || chunk"
    out = f"'[{lang}] ' || chunk"
    return f"""{name} AS (
  SELECT doc_id, page_idx, chunk_idx, '{lang}' AS target_lang, {out} AS translated, 'ok' AS status,
         CAST(1 AS INTEGER) AS attempts, {tokens(user)} AS prompt_tokens, {tokens(out)} AS completion_tokens,
         true AS usage_reported
  FROM {source}
)"""


def flaky_cte(source: str = "ck", lang: str = "pt", name: str = "tr") -> str:
    user = f"'Translate to {lang}:' || {NL} || chunk"
    out = f"'[{lang}] ' || chunk"
    return f"""fl AS (SELECT *, length(chunk) % 4 AS nf FROM {source}),
{name} AS (
  SELECT doc_id, page_idx, chunk_idx, '{lang}' AS target_lang,
         CASE WHEN nf < 3 THEN {out} ELSE '[CHUNK FAILED]' END AS translated,
         CASE WHEN nf < 3 THEN 'ok' ELSE 'failed' END AS status,
         CAST(least(nf + 1, 3) AS INTEGER) AS attempts,
         CASE WHEN nf < 3 THEN {tokens(user)} ELSE 0 END AS prompt_tokens,
         CASE WHEN nf < 3 THEN {tokens(out)} ELSE 0 END AS completion_tokens,
         nf < 3 AS usage_reported
  FROM fl
)"""


TR_COLS = ("doc_id, page_idx, chunk_idx, target_lang, translated, status, attempts, prompt_tokens, "
           "completion_tokens, usage_reported")


def doc_chunks(limit: int) -> list[str]:
    return [split_pages_cte("documents"), chunks_cte(limit)]


# --- file names ------------------------------------------------------------------

def manifest_cte() -> str:
    from versio.plans.standins import NAME_SHAPES

    stem = "'doc_' || CAST(doc_id AS VARCHAR)"
    shapes = ", ".join((f"{stem} || '{suf}'" if use else f"'{suf}'") for use, suf in NAME_SHAPES)
    return f"""m AS (
  SELECT doc_id, '/data/' || source || '/' || [{shapes}][doc_id % {len(NAME_SHAPES)} + 1] AS path
  FROM documents
),
mv AS (
  SELECT doc_id, path, regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)$', 1) AS suf_raw,
         regexp_extract(path, '([^/]*)$', 1) AS name
  FROM m
),
fv AS (
  SELECT doc_id, path, lower(suf_raw) AS suffix,
         CASE WHEN suf_raw = '' THEN name ELSE substr(name, 1, length(name) - length(suf_raw)) END AS stem,
         lower(suf_raw) IN ('.pdf', '.doc', '.docx', '.odt') AS format_ok
  FROM mv
)"""


# --- HTML extraction ---------------------------------------------------------------

# The HTML rules are stated here on their own, in RE2 syntax: tags of any case, named exactly; a quoted value after
# an equals sign may hold ">".
SQL_REST = "[^>=]*(?:=\\s*(?:\"[^\"]*\"|''[^'']*'')?[^>=]*)*"
SQL_ATTRS = f"(?:\\s{SQL_REST})?"
SQL_BLOCK_END = f"(?i)</(?:nav|div|article|footer|section|header)\\s*>|<hr{SQL_ATTRS}/?>"
SQL_LINE_BREAK = f"(?i)<br{SQL_ATTRS}/?>|</(?:p|h[1-6]|li)\\s*>|<p{SQL_ATTRS}>"
SQL_NOISE = f"(?is)<script{SQL_ATTRS}>.*?</script\\s*>|<style{SQL_ATTRS}>.*?</style\\s*>|<!--.*?-->"
SQL_TAG = f"(?i)</?[a-z]{SQL_REST}>|<[!?][^>]*>"
SQL_HREF = "(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))"


def _entity_map() -> str:
    """All named references of HTML that end in a semicolon, as a map."""
    from html.entities import html5

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(n[:-1])}: {quoted(c)}" for n, c in sorted(html5.items()) if n.endswith(";")) + "}"


def _decode(expr: str) -> str:
    """References by the pieces after '&': numeric or named, each decoded once."""
    def code(base: str) -> str:
        return f"try_cast({base}regexp_extract(x, '{{}}', 1) AS BIGINT)"

    dec = code("").format("^#([0-9]{1,7});")
    hexa = code("'0x' || ").format("^#[xX]([0-9a-fA-F]{1,6});")
    n = f"coalesce({dec}, {hexa})"
    ok = f"({n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111)"
    name = "regexp_extract(x, '^([a-zA-Z][a-zA-Z0-9]{1,40});', 1)"
    named = f"""CASE {name} WHEN '' THEN NULL WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '"' WHEN 'copy' THEN '©'
  WHEN 'middot' THEN '·' ELSE m[{name}] END"""
    piece = f"CASE WHEN {ok} THEN chr({n}::INT) || substr(x, instr(x, ';') + 1) ELSE coalesce({named} || substr(x, instr(x, ';') + 1), '&' || x) END"
    return f"(string_split({expr}, '&')[1] || array_to_string(list_transform(string_split({expr}, '&')[2:], lambda x: {piece}), ''))"


def _visible(expr: str) -> str:
    broken = f"regexp_replace({expr}, '{SQL_LINE_BREAK}', {NL}, 'g')"
    return _decode(f"regexp_replace({broken}, '{SQL_TAG}', '', 'g')")


def _marked(list_expr: str) -> str:
    return f"array_to_string(list_transform({list_expr}, lambda p: {strip('p')} || {SUFFIX_SQL}), '')"


def html_cte() -> str:
    md = "body"
    md = f"regexp_replace({md}, '(?is)<h1{SQL_ATTRS}>(.*?)</h1\\s*>', {NL} || '# \\1' || {NL}, 'g')"
    md = f"regexp_replace({md}, '(?is)<h2{SQL_ATTRS}>(.*?)</h2\\s*>', {NL} || '## \\1' || {NL}, 'g')"
    md = f"regexp_replace({md}, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*{SQL_HREF}{SQL_REST}>(.*?)</a\\s*>', '[\\4](\\1\\2\\3)', 'g')"
    md = f"regexp_replace({md}, '(?i)<li{SQL_ATTRS}>', {NL} || '- ', 'g')"
    articles = f"regexp_extract_all(body, '(?is)<article{SQL_ATTRS}>(.*?)</article\\s*>', 1)"
    articles = f"CASE WHEN len({articles}) > 0 THEN {articles} ELSE [''] END"
    return f"""ent AS (SELECT {_entity_map()} AS m),
hb0 AS (
  SELECT page_id AS doc_id, html, regexp_extract(html, '(?is)<body{SQL_ATTRS}>(.*)</body\\s*>', 1) AS b FROM pages
),
hb AS (
  SELECT doc_id, regexp_replace(CASE WHEN b = '' THEN html ELSE b END, '{SQL_NOISE}', '', 'g') AS body, m FROM hb0 CROSS JOIN ent
),
cand AS (
  SELECT doc_id, 'native' AS method, 1 AS priority,
         {_marked(f"list_transform(regexp_split_to_array(body, '{SQL_BLOCK_END}'), lambda blk: {_visible('blk')})")} AS text
  FROM hb
  UNION ALL
  SELECT doc_id, 'article', 2, {_marked(f"list_transform({articles}, lambda art: {_visible('art')})")}
  FROM hb
  UNION ALL
  SELECT doc_id, 'markdown', 3, {_visible(md)} FROM hb
),
best AS (
  SELECT doc_id, method, text,
         CASE WHEN {is_blank('text')} THEN 'empty_extraction' ELSE 'ok' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length({strip('text')}) DESC, priority) AS rn
        FROM cand)
  WHERE rn = 1
)"""


def _models_sql():
    from versio.sources import dimensions as d

    dm = ", ".join(f"('{p}', '{m}')" for p, m in d.DEFAULT_MODELS)
    prov = ", ".join(f"'{p}'" for p, _, _ in d.PROVIDERS)
    styles = ", ".join(f"('{p}', '{s}')" for p, s, _ in d.PROVIDERS)
    known = lit_list(d.OPENROUTER_MODELS)
    return dm, prov, styles, known


def _prices_sql():
    from versio.sources.dimensions import PRICES

    return ", ".join(f"('{m}', '{c}', {i!r}::DOUBLE, {o!r}::DOUBLE)" for m, c, i, o in PRICES)


def _oracles() -> dict[str, str]:
    from versio.plans.standins import COST_CACHES, COST_MODELS, MODEL_CHOICES, NAME_SHAPES, PROVIDER_CHOICES
    from versio.sources.dimensions import SYSTEM_PROMPT

    o: dict[str, str] = {}
    o["validate_formats"] = with_(manifest_cte()) + "SELECT doc_id, path, suffix, stem, format_ok FROM fv"
    o["conversion_route"] = with_(manifest_cte()) + """SELECT doc_id, path,
  CASE WHEN NOT format_ok THEN 'rejected' WHEN suffix = '.pdf' THEN 'passthrough' ELSE 'convert' END AS route,
  CASE WHEN format_ok AND suffix <> '.pdf' THEN stem || '.pdf' END AS pdf_name
FROM fv"""
    o["missing_files"] = with_(manifest_cte()) + """SELECT path AS name, 'missing' AS status FROM m
WHERE NOT EXISTS (SELECT 1 FROM m m2 JOIN labels l ON m2.doc_id = l.doc_id WHERE m2.path = m.path)"""

    suffix = f"{lit_list([suf for _, suf in NAME_SHAPES])}[doc_id % {len(NAME_SHAPES)} + 1]"
    o["scan_files"] = f"""WITH f AS (SELECT 'doc_' || doc_id || {suffix} AS name, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract(name, '(\\.[^./]+)$', 1) AS raw FROM f)
SELECT name, octet_length(encode(text))::BIGINT AS length, sha256(text) AS content_sha256, lower(raw) AS suffix,
  substr(name, 1, length(name) - length(raw)) AS stem
FROM s WHERE lower(raw) IN ('.pdf', '.txt', '.gz')"""
    o["file_pages"] = with_(f"""sf AS (
  SELECT coalesce(source, 'none') || '.txt' AS name, string_agg(replace(coalesce(text, ''), {NL}, {SUFFIX_SQL}) || {SUFFIX_SQL}, '' ORDER BY doc_id) AS text
  FROM documents GROUP BY 1
)""", split_pages_cte("sf", key="name")) + "SELECT doc_id AS name, page_idx::BIGINT AS page_idx, page FROM pg"

    o["extract_candidates"] = with_(html_cte()) + "SELECT doc_id, method, priority, text FROM cand"
    o["extract_best"] = with_(html_cte()) + "SELECT doc_id, method, text, status FROM best"
    o["choose_best"] = o["extract_best"]
    o["choose_best_stored"] = o["extract_best"]
    o["extraction_stats"] = with_(html_cte()) + f"""SELECT c.method, c.n_candidates, c.chars, c.stripped_chars,
  coalesce(w.n_chosen, 0) AS n_chosen, CAST(coalesce(w.chosen_chars, 0) AS BIGINT) AS chosen_chars
FROM (SELECT method, count(*) AS n_candidates, CAST(sum(length(text)) AS BIGINT) AS chars,
             CAST(sum(length({strip('text')})) AS BIGINT) AS stripped_chars FROM cand GROUP BY method) c
LEFT JOIN (SELECT method, count(*) AS n_chosen, CAST(sum(length(text)) AS BIGINT) AS chosen_chars
           FROM best GROUP BY method) w ON c.method = w.method"""
    o["mark_pages"] = with_(conv_marked_cte()) + "SELECT doc_id, text FROM cm"
    o["document_status"] = with_(html_cte()) + f"""SELECT doc_id, len({kept_pages('text')}) AS n_pages,
  CASE WHEN {is_blank('text')} THEN 'empty_extraction'
       WHEN len({kept_pages('text')}) = 0 THEN 'no_pages' ELSE 'ok' END AS status
FROM best"""

    o["split_pages"] = with_(marked_cte(), split_pages_cte("md")) + "SELECT doc_id, page_idx, page FROM pg"
    o["page_rows"] = with_(conv_marked_cte(), split_pages_cte("cm")) + "SELECT doc_id, page_idx, page FROM pg"
    o["page_counts"] = with_(marked_cte()) + f"SELECT doc_id, len({kept_pages('text')}) AS n_pages FROM md"
    n_pages = f"len({kept_pages("coalesce(text, '')")})"
    o["no_page_documents"] = with_(uneven_cte()) + f"SELECT doc_id, 'no_pages' AS status FROM ud WHERE {n_pages} = 0"
    state = f"""CASE WHEN {is_blank("coalesce(text, '')")} THEN 'empty_extraction'
       WHEN {n_pages} = 0 THEN 'no_pages' ELSE 'ok' END"""
    o["uneven_status"] = with_(uneven_cte()) + f"SELECT doc_id, {n_pages} AS n_pages, {state} AS status FROM ud"
    o["full_text_failures"] = with_(uneven_cte(), f"us AS (SELECT *, {state} AS state, length(text) % 5 = 0 AS bad FROM ud)") + f"""SELECT doc_id,
  CASE WHEN state <> 'ok' THEN state WHEN bad THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN state <> 'ok' THEN NULL WHEN bad THEN '[CHUNK FAILED]' ELSE '[pt] ' || text END AS translated,
  CASE WHEN state <> 'ok' THEN NULL WHEN bad THEN 3 ELSE 1 END::INTEGER AS attempts,
  CASE WHEN state <> 'ok' THEN NULL WHEN bad THEN 0 ELSE {tokens(f"'Translate to pt:' || {NL} || text")} END AS prompt_tokens
FROM us"""
    o["chunk_edges"] = with_(edge_cte(), split_pages_cte("ed"), chunks_cte(20)) + \
        f"SELECT doc_id, page_idx, chunk_idx, chunk, {tokens('chunk')} AS chunk_tokens FROM ck"
    o["extract_binary"] = f"""WITH c AS (
  SELECT page_id AS doc_id, 'paragraphs' AS method, 1 AS priority, {_marked("string_split(html, '<p>')")} AS text FROM pages
  UNION ALL SELECT page_id, 'head', 2, 'decoded: ' || html FROM pages
)
SELECT doc_id, method, text, CASE WHEN {is_blank('text')} THEN 'empty_extraction' ELSE 'ok' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length({strip('text')}) DESC, priority) AS rn FROM c)
WHERE rn = 1"""
    o["custom_formats"] = with_(manifest_cte()) + "SELECT doc_id, path, suffix, suffix IN ('.pdf', '.txt', '.gz') AS format_ok FROM fv"

    o["approx_tokens"] = f"SELECT doc_id, {tokens('text')} AS tokens FROM documents"
    for lim in (2000, 200, 20, 1):
        o[f"chunks_{lim}"] = with_(*doc_chunks(lim)) + \
            f"SELECT doc_id, page_idx, chunk_idx, chunk, {tokens('chunk')} AS chunk_tokens FROM ck"
    o["chunks_native_200"] = o["chunks_200"]
    o["chunks_native_20"] = o["chunks_20"]
    o["chunks_long_pages"] = o["chunks_200"]
    o["chunk_stats"] = with_(*doc_chunks(200)) + """SELECT pg.doc_id, pg.page_idx, coalesce(n, 0) AS n_chunks
FROM pg LEFT JOIN (SELECT doc_id, page_idx, count(*) AS n FROM ck GROUP BY doc_id, page_idx) c
  ON pg.doc_id = c.doc_id AND pg.page_idx = c.page_idx"""
    o["conversation_chunks"] = with_(conv_marked_cte(), split_pages_cte("cm"), chunks_cte(200)) + \
        f"SELECT doc_id, page_idx, chunk_idx, chunk, {tokens('chunk')} AS chunk_tokens FROM ck"

    dm, prov, styles, known = _models_sql()
    third = "((d.doc_id % 3) + 3) % 3 = 0"
    once_more = "rd AS (SELECT doc_id, text, lang FROM documents UNION ALL SELECT -1 - doc_id, text, 'xx' FROM documents WHERE doc_id % 7 = 0)"
    routed = f"""rt AS (
  SELECT d.doc_id, r.target_lang,
         lower(CASE WHEN {third} AND r.provider IS NOT NULL THEN {pick(PROVIDER_CHOICES, "d.doc_id")} ELSE r.provider END) AS provider,
         CASE WHEN {third} THEN {lit_list(MODEL_CHOICES)}[((d.doc_id % 4) + 4) % 4 + 1] ELSE '' END AS asked
  FROM rd d LEFT JOIN (VALUES ('en', 'pt', 'deepseek'), ('fr', 'en', 'OpenAI'), ('de', 'en', 'anthropic'), ('es', 'en', 'gemini')) r(lang, target_lang, provider)
    ON d.lang = r.lang
),
rm AS (
  SELECT rt.*, coalesce(nullif(asked, ''), dm.m) AS model, st.s AS request_style,
         CASE WHEN st.s IS NULL THEN 'unknown_provider' WHEN coalesce(nullif(asked, ''), dm.m) IS NULL THEN 'no_model' ELSE 'ok' END AS status
  FROM rt LEFT JOIN (VALUES {dm}) dm(p, m) ON rt.provider = dm.p LEFT JOIN (VALUES {styles}) st(p, s) ON rt.provider = st.p
),
rq AS (
  SELECT ck.doc_id, ck.page_idx, ck.chunk_idx, ck.chunk, rm.* EXCLUDE (doc_id, asked),
         'Translate to ' || rm.target_lang || ':' || {NL} || ck.chunk AS ask
  FROM ck JOIN rm ON ck.doc_id = rm.doc_id
)"""
    system = SYSTEM_PROMPT.replace("'", "''")
    o["build_requests"] = with_(once_more, split_pages_cte("rd"), chunks_cte(2000), routed) + f"""SELECT doc_id, page_idx, chunk_idx, target_lang, provider, model,
  status, request_style, ask AS "user", 0.0::DOUBLE AS temperature, CAST(8000 AS INTEGER) AS max_tokens,
  CASE WHEN request_style IS NOT NULL THEN model END AS body_model,
  CASE WHEN request_style IS NOT NULL THEN ask END AS body_user,
  CASE WHEN request_style IS NOT NULL THEN '{system}' END AS body_system,
  CASE WHEN request_style IS NOT NULL THEN 0.0::DOUBLE END AS body_temperature,
  CASE WHEN request_style IS NOT NULL THEN CAST(8000 AS INTEGER) END AS body_max_tokens
FROM rq"""
    out = "'[' || target_lang || '] ' || chunk"
    counted = "request_style IS NOT NULL AND provider <> 'gemini'"
    o["send_requests"] = with_(once_more, split_pages_cte("rd"), chunks_cte(2000), routed) + f"""SELECT doc_id, page_idx, chunk_idx, target_lang, provider,
  CASE WHEN request_style IS NOT NULL THEN {out} END AS translated,
  CASE WHEN request_style IS NOT NULL THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN request_style IS NOT NULL THEN 1 ELSE 0 END::INTEGER AS attempts,
  CASE WHEN {counted} THEN {tokens('ask')} ELSE 0 END AS prompt_tokens,
  CASE WHEN {counted} THEN {tokens(out)} ELSE 0 END AS completion_tokens,
  coalesce({counted}, false) AS usage_reported
FROM rq"""
    o["resolve_aliases"] = f"""WITH s AS (
  SELECT doc_id, {pick(PROVIDER_CHOICES)} AS provider, {pick(MODEL_CHOICES)} AS model FROM documents
),
a AS (SELECT *, CASE lower(provider) WHEN 'mistral' THEN 'openrouter' WHEN 'gpt' THEN 'openai' ELSE lower(provider) END AS pr FROM s),
r AS (SELECT a.*, coalesce(nullif(model, ''), dm.m) AS model_resolved FROM a LEFT JOIN (VALUES {dm}) dm(p, m) ON a.pr = dm.p)
SELECT doc_id, provider, model, pr AS provider_resolved, model_resolved,
  CASE WHEN pr = 'openrouter' THEN coalesce(list_contains({known}, model_resolved), false) ELSE true END AS model_known,
  CASE WHEN pr NOT IN ({prov}) THEN 'unknown_provider' WHEN model_resolved IS NULL THEN 'no_model' ELSE 'ok' END AS status
FROM r"""
    o["resume_failed"] = with_(*doc_chunks(200), flaky_cte(), echo_cte(name="te")) + f"""SELECT {TR_COLS}, 1 AS pass FROM tr WHERE status = 'ok'
UNION ALL
SELECT {TR_COLS}, 2 FROM te WHERE EXISTS (SELECT 1 FROM tr WHERE tr.status = 'failed' AND tr.doc_id = te.doc_id
  AND tr.page_idx = te.page_idx AND tr.chunk_idx = te.chunk_idx)"""
    o["resolve_models"] = f"""WITH s AS (
  SELECT doc_id, {pick(PROVIDER_CHOICES)} AS provider, {pick(MODEL_CHOICES)} AS model FROM documents
),
r AS (
  SELECT s.*, lower(provider) AS pr,
         coalesce(nullif(model, ''), dm.m) AS model_resolved
  FROM s LEFT JOIN (VALUES {dm}) dm(p, m) ON lower(s.provider) = dm.p
)
SELECT doc_id, provider, model, pr AS provider_resolved, model_resolved,
  CASE WHEN pr = 'openrouter' THEN coalesce(list_contains({known}, model_resolved), false) ELSE true END
    AS model_known,
  CASE WHEN pr NOT IN ({prov}) THEN 'unknown_provider' WHEN model_resolved IS NULL THEN 'no_model'
       ELSE 'ok' END AS status
FROM r"""
    o["parse_responses"] = _parse_sql()

    o["provider_service"] = with_(*doc_chunks(2000), echo_cte()) + f"""SELECT 'anthropic' AS provider, {TR_COLS} FROM tr
UNION ALL
SELECT 'gemini', doc_id, page_idx, chunk_idx, target_lang, translated, status, attempts, 0, 0, false FROM tr"""
    o["reply_usage"] = f"""WITH r AS (
  SELECT doc_id, n_chars AS p, doc_id + 1 AS c, floor(n_chars * (doc_id % 5) / 4)::BIGINT AS hit, doc_id % 4 AS k,
         {lit_list(COST_MODELS[1:])}[doc_id % 3 + 1] AS model
  FROM documents
),
t AS (
  SELECT doc_id, CASE k WHEN 2 THEN 'content_blocks' ELSE 'choices' END AS reply_style, model,
         CASE k WHEN 2 THEN p - hit ELSE p END AS prompt_tokens, c AS completion_tokens, CASE k WHEN 3 THEN 0 ELSE hit END AS hit_tokens,
         CASE k WHEN 2 THEN p - hit + 7 WHEN 3 THEN p ELSE p - hit END AS miss_tokens, CASE k WHEN 1 THEN 2 * c END AS reasoning_tokens
  FROM r
)
SELECT t.*, hit_tokens / 1000000 * h.i + miss_tokens / 1000000 * m.i + completion_tokens / 1000000 * m.o AS cost_usd,
  CASE WHEN m.i IS NULL THEN 'no_price' ELSE 'ok' END AS cost_status
FROM t LEFT JOIN (VALUES {_prices_sql()}) h(m, c, i, o) ON h.m = model AND h.c = 'hit'
LEFT JOIN (VALUES {_prices_sql()}) m(m, c, i, o) ON m.m = model AND m.c = 'miss'"""
    o["chunks_table_function"] = o["chunks_200"]

    o["translate_stub"] = with_(*doc_chunks(2000), echo_cte()) + f"SELECT {TR_COLS} FROM tr"
    o["translate_failures"] = with_(*doc_chunks(200), flaky_cte()) + f"SELECT {TR_COLS} FROM tr"
    o["full_text_mode"] = with_(
        marked_cte(),
        "fu AS (SELECT doc_id, CAST(0 AS INTEGER) AS page_idx, CAST(0 AS INTEGER) AS chunk_idx, text AS chunk FROM md)",
        echo_cte("fu"),
    ) + f"SELECT {TR_COLS} FROM tr"

    sums = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens_total,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens_total,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens_total"""
    o["reassemble"] = with_(*doc_chunks(2000), echo_cte(), manifest_cte()) + f"""SELECT doc_id, target_lang,
  coalesce(nullif(any_value(stem), ''), 'doc_' || CAST(doc_id AS VARCHAR)) || '_' || target_lang || '.md' AS output_name,
  string_agg(translated, {NL} || {NL} ORDER BY page_idx, chunk_idx) AS content
FROM tr JOIN fv USING (doc_id) GROUP BY doc_id, target_lang"""
    o["export_markdown"] = with_(*doc_chunks(2000), echo_cte(), manifest_cte()) + f"""SELECT output_name, sha256(content) AS content_sha256, length(content) AS n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY output_name ORDER BY doc_id DESC) AS place FROM (
  SELECT doc_id, coalesce(nullif(any_value(stem), ''), 'doc_' || CAST(doc_id AS VARCHAR)) || '_' || target_lang || '.md' AS output_name,
         string_agg(translated, {NL} || {NL} ORDER BY page_idx, chunk_idx) AS content
  FROM tr JOIN fv USING (doc_id) GROUP BY doc_id, target_lang))
WHERE place = 1"""
    o["usage_by_document"] = with_(*doc_chunks(200), flaky_cte()) + f"""SELECT doc_id, target_lang, {sums},
  count(*) AS n_chunks, CAST(count_if(status = 'failed') AS BIGINT) AS n_failed
FROM tr GROUP BY doc_id, target_lang"""
    o["usage_stream"] = o["usage_by_document"]
    o["document_table"] = o["reassemble"]
    o["usage_total"] = with_(*doc_chunks(200), flaky_cte()) + f"""SELECT {sums},
  count(*) AS n_chunks, CAST(count_if(status = 'failed') AS BIGINT) AS n_failed FROM tr"""
    o["chunks_per_page"] = with_(*doc_chunks(20)) + \
        "SELECT doc_id, page_idx, count(*) AS n_chunks FROM ck GROUP BY doc_id, page_idx"

    priced = with_(*doc_chunks(2000), echo_cte(), f"""u AS (
  SELECT doc_id, target_lang, {sums} FROM tr GROUP BY doc_id, target_lang
),
uc AS (SELECT *, {pick(COST_MODELS)} AS model, {pick(COST_CACHES)} AS cache FROM u),
pr AS (
  SELECT uc.*, p.i IS NOT NULL AS found,
         prompt_tokens_total / 1000000 * p.i + completion_tokens_total / 1000000 * p.o AS cost
  FROM uc LEFT JOIN (VALUES {_prices_sql()}) p(m, c, i, o) ON uc.model = p.m AND uc.cache = p.c
)""")
    o["estimate_cost"] = priced + """SELECT doc_id, target_lang, model, cache, prompt_tokens_total,
  completion_tokens_total, CASE WHEN found THEN cost END AS cost_usd,
  CASE WHEN found THEN 'ok' ELSE 'no_price' END AS cost_status
FROM pr"""
    o["usage_report"] = priced + """SELECT doc_id, target_lang, prompt_tokens_total, completion_tokens_total,
  total_tokens_total, CASE WHEN found THEN 'ok' ELSE 'no_price' END AS cost_status,
  CASE WHEN found THEN printf('$%.4f', cost) END AS cost_text
FROM pr"""
    o["translate_documents"] = with_(*doc_chunks(2000), echo_cte()) + f"""SELECT doc_id, target_lang,
  string_agg(translated, {NL} || {NL} ORDER BY page_idx, chunk_idx) AS content, {sums},
  CAST(count_if(status = 'failed') AS BIGINT) AS n_failed
FROM tr GROUP BY doc_id, target_lang"""

    o["sql_functions"] = with_(
        "pg AS (SELECT doc_id, CAST(0 AS INTEGER) AS page_idx, text AS page FROM documents)", chunks_cte(200)
    ) + f"""SELECT d.doc_id, {tokens('d.text')} AS tokens, coalesce(c.n, 0) AS n_chunks,
  {tokens('d.text')} / 1000000 * 0.14::DOUBLE + d.n_chars / 1000000 * 1.1::DOUBLE AS cost_usd
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ck GROUP BY doc_id) c ON d.doc_id = c.doc_id"""

    cols = []
    for name, pat in (("url", r"https?://[^ \t\n\r<>\"]+"), ("doi", r"10\.[0-9]{4,9}/[^ \t\n\r<>\"]+"),
                      ("display_math", r"\$\$[^$]+\$\$"), ("inline_math", r"\$[^$]+\$")):
        src = f"regexp_extract_all(ck.chunk, '{pat}')"
        dst = f"regexp_extract_all(tr.translated, '{pat}')"
        cols.append(f"CAST(sum(len({src})) AS BIGINT) AS {name}_n")
        times = "len(list_filter({}, lambda y: y = x))"
        short = f"list_transform(list_distinct({src}), lambda x: greatest({times.format(src)} - {times.format(dst)}, 0))"
        cols.append(f"CAST(sum(coalesce(list_sum({short}), 0)) AS BIGINT) AS {name}_lost")
    o["preservation_check"] = with_(*doc_chunks(2000), echo_cte()) + f"""SELECT tr.doc_id, tr.target_lang,
  {", ".join(cols)}
FROM tr JOIN ck ON tr.doc_id = ck.doc_id AND tr.page_idx = ck.page_idx AND tr.chunk_idx = ck.chunk_idx
GROUP BY tr.doc_id, tr.target_lang"""
    return o


def _parse_sql() -> str:
    from versio.plans.standins import REPLY_STYLES

    n = len(REPLY_STYLES)
    choice = "json_object('message', json_object('content', text))"
    bodies = [
        f"json_object('choices', json_array({choice}), 'usage', json_object('prompt_tokens', n_chars, "
        f"'completion_tokens', doc_id + 1, 'total_tokens', n_chars + doc_id + 1))",
        f"json_object('choices', json_array({choice}))",
        "json_object('content', json_array(json_object('type', 'text', 'text', text)), 'usage', "
        "json_object('input_tokens', n_chars, 'output_tokens', doc_id + 1))",
        "json_object('choices', json_array(json_object('message', json_object('content', NULL))), 'usage', "
        "json_object('prompt_tokens', n_chars, 'completion_tokens', 0))",
        "json_object('text', text)",
        "'{}'::JSON",
    ]
    body = "[" + ", ".join(f"CAST({b} AS VARCHAR)" for b in bodies) + f"][doc_id % {n} + 1]"
    return f"""WITH r AS (
  SELECT doc_id, {pick(REPLY_STYLES)} AS reply_style, {body} AS body FROM documents
),
j AS (
  SELECT doc_id, reply_style, body,
         json_extract_string(body, '$.choices[0].message.content') AS c0,
         json_extract(body, '$.choices') AS ch,
         json_extract_string(body, '$.content[0].text') AS b0,
         json_extract_string(body, '$.text') AS tx,
         json_extract(body, '$.usage') AS u,
         CAST(json_extract(body, '$.usage.prompt_tokens') AS BIGINT) AS pt,
         CAST(json_extract(body, '$.usage.completion_tokens') AS BIGINT) AS ct,
         CAST(json_extract(body, '$.usage.input_tokens') AS BIGINT) AS it,
         CAST(json_extract(body, '$.usage.output_tokens') AS BIGINT) AS ot
  FROM r
),
t AS (
  SELECT *, CASE reply_style
      WHEN 'choices' THEN c0
      WHEN 'choices_or_empty' THEN CASE WHEN ch IS NOT NULL AND json_array_length(ch) > 0
                                        THEN coalesce(c0, '') END
      WHEN 'content_blocks' THEN b0
      WHEN 'text_only' THEN tx END AS translated
  FROM j
)
SELECT doc_id, reply_style, translated,
  CASE WHEN translated IS NOT NULL THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN translated IS NOT NULL AND reply_style <> 'text_only' THEN coalesce(pt, it, 0) ELSE 0 END
    AS prompt_tokens,
  CASE WHEN translated IS NOT NULL AND reply_style <> 'text_only' THEN coalesce(ct, ot, 0) ELSE 0 END
    AS completion_tokens,
  (translated IS NOT NULL AND reply_style <> 'text_only' AND (pt IS NOT NULL OR ct IS NOT NULL OR it IS NOT NULL OR ot IS NOT NULL)) AS usage_reported
FROM t"""


ORACLES = _oracles()
