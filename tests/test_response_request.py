"""Requests, model resolution, reply parsing."""

import json

from versio.operators.services import ProviderAdapter, get_service
from versio.operators.request import build_requests, resolve_models
from versio.operators.response import parse_responses

import pytest

REPLIES = [  # FIXTURES.md section 6
    ("choices", '{"choices":[{"message":{"content":"x"}}],"usage":{"prompt_tokens":5,"completion_tokens":2,"total_tokens":7}}',
     "x", 5, 2, True, "ok"),
    ("choices", '{"choices":[{"message":{"content":"x"}}]}', "x", 0, 0, False, "ok"),
    ("content_blocks", '{"content":[{"type":"text","text":"t"}],"usage":{"input_tokens":3,"output_tokens":4}}',
     "t", 3, 4, True, "ok"),
    ("choices_or_empty", '{"choices":[{"message":{"content":null}}],"usage":{"prompt_tokens":1,"completion_tokens":0}}',
     "", 1, 0, True, "ok"),
    ("text_only", '{"text":"g"}', "g", 0, 0, False, "ok"),
    ("text_only", "{}", None, 0, 0, False, "failed"),
]


def test_parse_replies(spark):
    df = spark.createDataFrame([(i, s, b) for i, (s, b, *_) in enumerate(REPLIES)], "doc_id long, reply_style string, body string")
    got = {r.doc_id: r for r in parse_responses(df).collect()}
    for i, (_, _, text, p, c, rep, status) in enumerate(REPLIES):
        r = got[i]
        assert (r.translated, r.prompt_tokens, r.completion_tokens, r.usage_reported, r.status) == (text, p, c, rep, status)


def test_resolve_models(spark):
    specs = spark.createDataFrame(
        [(1, "OpenAI", ""), (2, "openrouter", "qwen/qwen-max"), (3, "openrouter", "nope"), (4, "mistral", ""),
         (5, "deepseek", "deepseek-reasoner")], "doc_id long, provider string, model string")
    r = {x.doc_id: x for x in resolve_models(specs).collect()}
    assert (r[1].provider_resolved, r[1].model_resolved, r[1].status) == ("openai", "gpt-4o-mini", "ok")
    assert r[2].model_known is True and r[3].model_known is False and r[3].status == "ok"
    assert r[4].status == "unknown_provider"
    assert r[5].model_resolved == "deepseek-reasoner"
    aliased = {x.doc_id: x for x in resolve_models(specs, aliases=[("openrouter", "gemini")]).collect()}
    assert (aliased[2].provider_resolved, aliased[2].model_resolved) == ("gemini", "qwen/qwen-max")


def test_request_bodies(spark):
    rows = [(1, 0, 0, "pt", p, "m", "hello") for p in ("deepseek", "anthropic", "gemini")]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, chunk_idx int, target_lang string, provider string, model string, chunk string")
    got = {r.provider: json.loads(r.body) for r in build_requests(df).collect()}
    user = "Translate to pt:\nhello"
    assert got["deepseek"]["messages"][1] == {"role": "user", "content": user}
    assert got["deepseek"]["temperature"] == 0 and got["deepseek"]["max_tokens"] == 8000
    assert got["anthropic"]["messages"] == [{"role": "user", "content": user}] and "system" in got["anthropic"]
    assert got["gemini"]["contents"] == user and got["gemini"]["config"]["max_output_tokens"] == 8000


def test_adapter_reads_each_shape():
    replies = {"deepseek": {"choices": [{"message": {"content": "a"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}},
               "anthropic": {"content": [{"type": "text", "text": "b"}], "usage": {"input_tokens": 3, "output_tokens": 4}},
               "gemini": {"text": "c"}}
    sent = []

    def post(provider, body):
        sent.append((provider, body))
        return json.dumps(replies[provider])

    assert get_service("deepseek", "deepseek-chat", post)("x", "pt") == ("a", {"prompt_tokens": 1, "completion_tokens": 2})
    assert ProviderAdapter("anthropic", "m", post)("x", "pt") == ("b", {"input_tokens": 3, "output_tokens": 4})
    assert ProviderAdapter("gemini", "m", post)("x", "pt") == ("c", {})
    assert json.loads(sent[0][1])["messages"][1]["content"] == "Translate to pt:\nx"
    with pytest.raises(ValueError):
        get_service("nope", "m", post)


def test_build_send_parse_round_trip(spark):
    """E2 -> dispatch -> E12-E17 entirely table to table; a fake transport
    answers in each provider's reply shape and fails one request for good."""
    from versio.operators.dispatch import send_requests

    def post(provider, body):
        req = json.loads(body)
        user = req["messages"][-1]["content"] if "messages" in req else req["contents"]
        text = user.split("\n", 1)[1].upper()
        if text == "BOOM":
            raise ConnectionError("service down")
        if provider == "anthropic":
            return json.dumps({"content": [{"type": "text", "text": text}],
                               "usage": {"input_tokens": 7, "output_tokens": 3}})
        if provider == "gemini":
            return json.dumps({"text": text})
        return json.dumps({"choices": [{"message": {"content": text}}],
                           "usage": {"prompt_tokens": 5, "completion_tokens": 2}})

    rows = [(i, 0, 0, "pt", p, "m", t) for i, (p, t) in
            enumerate([("deepseek", "abc"), ("anthropic", "def"), ("gemini", "ghi"), ("openai", "boom")])]
    chunks = spark.createDataFrame(rows, "doc_id long, page_idx int, chunk_idx int, target_lang string, "
                                         "provider string, model string, chunk string")
    replies = send_requests(build_requests(chunks), post, concurrency=2, sleep=lambda s: None)
    got = {r.doc_id: r for r in parse_responses(replies).collect()}
    assert (got[0].translated, got[0].prompt_tokens, got[0].completion_tokens) == ("ABC", 5, 2)
    assert (got[1].translated, got[1].prompt_tokens, got[1].completion_tokens) == ("DEF", 7, 3)
    assert (got[2].translated, got[2].usage_reported) == ("GHI", False)
    assert (got[3].status, got[3].attempts) == ("failed", 3) and "service down" in got[3].error
