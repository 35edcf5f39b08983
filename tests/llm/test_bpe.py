import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versio.llm import bpe
from versio.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    with open(vocabulary()) as f:
        content = f.read()
    return bpe.WordBpe(content), Tokenizer.from_str(content)


def same(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    return own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_of_the_fast_path(both):
    for c in map(chr, [*range(0x300), *range(0x2000, 0x2070), *range(0x2098, 0x20D0)]):
        assert same(both, f"a{c}B {c}{c}'s{c}1")


def test_texts(both):
    for text in ("", " ", "don't we'll I'M they'd", "<|endoftext|>a<|startoftext|> B<|endoftext|>", "ΑΣ Σ ΟΔΟΣ", "İstanbul ǅ", "e\u0301 \u212b", "日本語 text", "²³¼ ⅷ", "a\x1cb\x85c\u2028d", "x" * 5000, "ab" * 20000 + " " + "!?" * 3000, "<|endoftext|", "\U0001f600" * 50):
        assert same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrstTHE'sdm 019.,!\n\tÉßΣσİ\u0301\u2003日😀<|>_-")), max_size=60))
def test_any_text(both, text):
    assert same(both, text)


def test_merge_is_leftmost_lowest_first():
    ranks = {1 << 32 | 1: (0, 2), 2 << 32 | 1: (1, 3), 2 << 32 | 2: (2, 4)}
    assert bpe.merge([1] * 3, ranks) == [3] and bpe.merge([1] * 4, ranks) == [4] and bpe.merge([1] * 5, ranks) == [2, 3]
    assert bpe.merge([], ranks) == [] and bpe.merge([7], ranks) == [7] and bpe.merge([7, 8], ranks) == [7, 8]
    rng = np.random.default_rng(0)
    table = {a << 32 | b: (int(r), 10 + int(r)) for r, (a, b) in enumerate(rng.permutation([(a, b) for a in range(6) for b in range(6)])[:30].tolist())}
    for n in range(2, 40):
        word = rng.integers(0, 6, n).tolist()
        plain = list(word)
        while True:
            best = min(((table[k][0], i) for i in range(len(plain) - 1) if (k := plain[i] << 32 | plain[i + 1]) in table), default=None)
            if best is None:
                break
            i = best[1]
            plain[i:i + 2] = [table[plain[i] << 32 | plain[i + 1]][1]]
        assert bpe.merge(list(word), table) == plain


def test_kept_words_are_bounded(both, monkeypatch):
    own = bpe.WordBpe(open(vocabulary()).read())
    monkeypatch.setattr(bpe, "KEPT_CHARS", 10)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    text = " ".join(f"w{chr(97 + k)}" for k in range(26)) * 2
    assert own.encode(text) == both[1].encode(text, add_special_tokens=False).ids
    assert len(own.young) <= 8 and len(own.old) <= 8


def test_cases(spark, both):
    rows = [(1, "Hello wörld, hello", 1), (2, None, 1), (3, "", 1), (4, "  \n", 1), (1, "Hello wörld, hello", 1), (None, "x", 1), (5, "long " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    ids = bpe.encode(df, vocabulary())
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert ids.columns == ["doc_id", "ids"] and ids.count() == 7
    assert got[2] == got[3] == got[4] == [] and got[1] == both[1].encode(rows[0][1], add_special_tokens=False).ids and len(got[5]) == 200_000
    back = {r.doc_id: r.decoded for r in bpe.decode(ids, vocabulary()).collect()}
    assert back[2] == "" and back[1] == both[1].decode(got[1], skip_special_tokens=False)
    assert both[0].words(got[1]) == "hello wörld , hello "
    assert bpe.digests(df, vocabulary()).count() == 7 and bpe.encode(df.limit(0), vocabulary()).count() == 0


def test_texts_off_the_fast_path_use_the_word_table(both):
    own, _ = both
    for text in ("quoted “words” don’t — stay… €5", "日本語 mixed with words", "words ᾳ words"):
        assert same(both, text)
    own.young, own.old, own.chars = {}, {}, 0
    own.encode("日本 words " * 50)
    assert {"日本", "words"} <= set(own.young)
