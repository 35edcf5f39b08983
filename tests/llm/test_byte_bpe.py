"""Byte-level BPE against the library called on each match of the pattern."""

import base64
import hashlib
import random
import re

import duckdb
import public_tokenizers as P
import pytest
import regex
import tiktoken

import __spark_entry__ as E
from versio.llm import byte_bpe as B

SF = "/root/testdata/sf0.001"
FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as f:
        return B.RankBpe(f.read(), P.PATTERN)


def test_parts_have_the_ids_of_the_whole(library, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "ß", "字", "1", "२", "'", "s", "re", "'ll", "!", "?", "́", "\n", "\t", " ", "  ", " ", "　", "\xa0", "\x1c", "\x85", "😀", "​"]
    for _ in range(1500):
        monkeypatch.setattr(B, "_LONG", re.compile(f"[{B._SPACE}]{{{rng.choice([2, 3, 5])},}}"))
        text = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 6]) for _ in range(rng.randint(0, 80)))
        cut = list(B.parts(text, rng.choice([1, 3, 10, 50])))
        assert "".join(p for p, _ in cut) == text
        ids = [i for p, space in cut for i in (library._encode_single_piece(p) if space else library.encode_ordinary(p))]
        assert ids == library.encode_ordinary(text), text


def test_white_space_is_that_of_the_pattern():
    space = regex.compile(r"\s")
    ours = re.compile(f"[{B._SPACE}]")
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        # the library's pattern follows the Unicode property, which leaves out the separators 1C to 1F
        assert bool(ours.match(c)) == (bool(space.match(c)) and not "\x1c" <= c <= "\x1f"), hex(ord(c))


def test_long_stretches(model, library):
    word = "lorem " * 30_000 + "ab" * 60_000 + "!?" * 60_000 + "x1" * 50_000
    assert model.encode(word).tolist() == library.encode_ordinary(word)
    # the library itself gives up on a million spaces
    text = " " * 1_200_000 + "x" + "\n" * 1_100_000 + "y" + " " * 1_000_000
    ids = model.encode(text)
    assert model.decode(ids) == text.encode()
    pieces = [" " * 1_199_999, " x", "\n" * 1_099_999, "\n", "y", " " * 1_000_000]
    assert ids.tolist() == [i for p in pieces for i in library._encode_single_piece(p)]


def test_another_pattern_is_refused():
    with open(FILE, "rb") as f, pytest.raises(ValueError):
        B.RankBpe(f.read(), r"\w+|\W+")


def test_cases(spark, library):
    texts = [(1, "plain text's"), (1, "plain text's"), (None, "ünïcödé 字"), (2, None), (3, ""), (4, " "), (5, "long words " * 20_000), (6, "<|endoftext|>")]
    docs = spark.createDataFrame([(*t, [0]) for t in texts], "doc_id bigint, text string, ids array<int>")
    encoded = B.encode(docs, FILE, P.PATTERN)
    decoded = B.decode(encoded.withColumn("decoded_", encoded.ids), FILE, P.PATTERN, keep=("decoded_",)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((d, t or "") for d, t in texts), key=key)
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in sorted(decoded, key=key)] == want
    assert [list(r.decoded_) for r in sorted(decoded, key=key)] == [library.encode_ordinary(t) for _, t in want]
    assert B.encode(docs.limit(0), FILE, P.PATTERN).collect() == []
    # ids need not make whole characters
    half = spark.createDataFrame([(1, library.encode_ordinary("字")[:1]), (2, None)], "doc_id bigint, ids array<int>")
    cut = {r.doc_id: bytes(r.decoded) for r in B.decode(half, FILE, P.PATTERN).collect()}
    assert "字".encode().startswith(cut[1]) and cut[2] == b""


def test_op13_equals_the_library(spark, library):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op13_byte_bpe"](spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids)))
    assert len(got) == len(docs)
