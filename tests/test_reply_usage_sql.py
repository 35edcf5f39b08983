"""Raw usage of replies, the table function, and HTML as pages on the web have it."""

from versio.functions.sql import register
from versio.operators import extract, response, usage
from versio.operators.chunk import chunk_documents


def test_usage_of_any_shape_survives(spark):
    rows = [
        (1, "deepseek-chat", "choices", '{"choices":[{"message":{"content":"x"}}],"usage":{"prompt_tokens":1000000,"completion_tokens":0,"prompt_cache_hit_tokens":400000,"prompt_cache_miss_tokens":600000,"own":{"deep":[1,{"k":"v"}]}}}'),
        (2, "deepseek-chat", "choices", '{"choices":[{"message":{"content":"x"}}]}'),
        (3, "deepseek-chat", "choices", "not json"),
        (4, "deepseek-chat", "choices", None),
        (5, "other", "content_blocks", '{"content":[{"type":"text","text":"x"}],"usage":{"input_tokens":10,"output_tokens":2,"cache_read_input_tokens":90}}'),
        (6, "deepseek-chat", "text_only", '{"text":"x","usage":{"prompt_tokens":5}}'),
        (7, "deepseek-chat", "choices", '{"choices":[{"message":{"content":"x"}}],"usage":{"prompt_tokens":"many","completion_tokens":3,"prompt_tokens_details":null}}'),
    ]
    raw = spark.createDataFrame(rows, "id int, model string, reply_style string, body string")
    parsed = response.parse_responses(raw, raw_usage=True)
    got = {r.id: r for r in usage.reply_cost(usage.reply_tokens(parsed)).collect()}
    assert (got[1].hit_tokens, got[1].miss_tokens) == (400_000, 600_000) and abs(got[1].cost_usd - (0.4 * 0.07 + 0.6 * 0.14)) < 1e-12
    assert got[1].usage.toPython()["own"] == {"deep": [1, {"k": "v"}]}
    assert all((got[k].hit_tokens, got[k].miss_tokens, got[k].cost_usd) == (0, 0, 0.0) for k in (2, 3, 4, 6))
    assert got[3].usage is None and got[4].usage is None
    assert (got[5].hit_tokens, got[5].miss_tokens, got[5].cost_status, got[5].cost_usd) == (90, 10, "no_price", None)
    assert got[7].completion_tokens == 3 and got[7].hit_tokens == 0
    assert "usage" not in response.parse_responses(raw).columns


def test_table_function_equals_the_operator(spark):
    register(spark)
    docs = spark.createDataFrame([(1, "a b\n" * 50 + "<<<PAGE_BREAK>>>" + "w " * 300), (2, None), (3, ""), (4, " \n"), (4, "again")], "doc_id long, text string")
    for limit in (1, 20, 2000):
        got = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunks(d.text, {n}) c", docs=docs, n=limit)
        want = chunk_documents(docs, limit)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def candidates(spark, html):
    return {r.method: r.text for r in extract.html_candidates(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}


def test_named_references_in_full(spark):
    html = "<body><article>caf&eacute; &mdash; &euro;5 &hellip; &NotEqualTilde; &CounterClockwiseContourIntegral; &amp;eacute; &#38;lt; &nosuch; &eacute &; &</article></body>"
    text = candidates(spark, html)["article"]
    assert text.startswith("café — €5 … ≂̸ ∳ &eacute; &lt; &nosuch; &eacute &; &")


def test_every_named_reference(spark):
    import html as library

    names = sorted(n for n in extract.html5 if n.endswith(";"))
    df = spark.createDataFrame([(n, f"x&{n}y") for n in names], "name string, t string")
    got = {r.name: r.d for r in df.select("name", extract.decode_entities("t").alias("d")).collect()}
    assert got == {n: "x" + library.unescape(f"&{n}") + "y" for n in names} and len(got) > 2000


def test_tags_with_quoted_values(spark):
    html = """<body><p title="a > b" data-x='c > d'>one</p><a class=x href='/single'>s</a> <a href=/bare>b</a> <A HREF = "/spaced" >p</A>
<a data-href="/no">n</a> 1 < 2 <i title=it's>three</i><!-- > --><img alt="x>y"/><h1 id="a>b">Head</h1 ></body>"""
    got = candidates(spark, html)["markdown"]
    assert "[s](/single)" in got and "[b](/bare)" in got and "[p](/spaced)" in got and "[n]" not in got
    assert "one" in got and "a > b" not in got and "x>y" not in got and "1 < 2 three" in got and "# Head\n" in got
