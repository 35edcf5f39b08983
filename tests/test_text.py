"""H1-H5: whitespace class, strip, words, token estimate."""


from versio.functions.text import WS_CHARS, approx_tokens, is_blank, strip, words


def _bmp():
    return [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]


def test_whitespace_set_is_python_isspace():
    assert WS_CHARS == "".join(chr(c) for c in _bmp() if chr(c).isspace())
    for c in ("\u0085", "\u00a0", "\u2003", "\u3000", "\x1c", "\x1f"):
        assert c in WS_CHARS
    assert "\u200b" not in WS_CHARS


def test_strip_matches_python_on_every_bmp_code_point(spark):
    rows = [(c, chr(c) + "a" + chr(c)) for c in _bmp()]
    df = spark.createDataFrame(rows, "cp int, s string")
    got = {r.cp: r.t for r in df.select("cp", strip("s").alias("t")).collect()}
    assert all(got[c] == (chr(c) + "a" + chr(c)).strip() for c in got)


def test_words_and_blank(spark):
    texts = ["  a\tb c\u3000\u00a0d  ", "", "   ", "x\u200by z"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(words("s").alias("w"), is_blank("s").alias("b")).collect()
    assert [r.w for r in rows] == [t.split() for t in texts]
    assert [r.b for r in rows] == [not t.strip() for t in texts]


def test_approx_tokens(spark):
    texts = ["", "a", "abcd", "abcde", "é" * 9, "\U0001F600" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.t for r in df.select(approx_tokens("s").alias("t")).collect()]
    assert got == [-(-len(t) // 4) for t in texts]
