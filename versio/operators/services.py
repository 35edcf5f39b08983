"""Service plug-ins (U1, E5, E7, E12-E16 on the Python side).

A service is a picklable callable ``(text, target_lang) -> (text, usage)``.

* ``ProviderAdapter`` builds the provider-shaped request body and hands it
  as JSON to a caller-supplied ``post(provider, body_json) -> reply JSON`` (the
  same transport signature ``dispatch.send_requests`` uses); the transport,
  keys and endpoints stay with the caller (no SDKs are bundled). The reply is
  read in the provider's shape.
* ``get_service`` is the registry: an unknown provider is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from versio.sources import dimensions as dims

_STYLES = {name: (req, rep) for name, req, rep in dims.PROVIDERS}


def py_user_message(text: str, lang: str) -> str:
    return f"Translate to {lang}:\n{text}"


def request_body(provider: str, model: str, text: str, lang: str, *,
                 system_prompt: str = dims.SYSTEM_PROMPT) -> dict:
    style = _STYLES[provider][0]
    user = py_user_message(text, lang)
    t, cap = dims.TEMPERATURE, dims.MAX_OUTPUT_TOKENS
    if style == "chat":
        return {"model": model, "messages": [{"role": "system", "content": system_prompt},
                                             {"role": "user", "content": user}],
                "temperature": t, "max_tokens": cap}
    if style == "system_field":
        return {"model": model, "max_tokens": cap, "temperature": t, "system": system_prompt,
                "messages": [{"role": "user", "content": user}]}
    return {"model": model, "contents": user,
            "config": {"temperature": t, "max_output_tokens": cap, "system_instruction": system_prompt}}


def read_reply(provider: str, reply: dict) -> tuple:
    """(text, usage) from a reply in the provider's shape; raises when the
    shape is wrong so the retry loop sees it."""
    style = _STYLES[provider][1]
    if style in ("choices", "choices_or_empty"):
        content = reply["choices"][0]["message"]["content"]
        # a reply without usage reports none, on this path as in ``parse_responses``
        usage = reply.get("usage") or {}
        return (content or "") if style == "choices_or_empty" else content, usage
    if style == "content_blocks":
        return reply["content"][0]["text"], reply.get("usage") or {}
    return reply.get("text"), {}


def check_reply(provider: str, reply: str) -> None:
    """Raise unless ``reply`` is JSON in the provider's shape with a text."""
    if read_reply(provider, json.loads(reply))[0] is None:
        raise ValueError("reply has no text")


class ProviderAdapter:
    """Provider adapter over a caller-supplied transport ``post(provider, body_json) -> str``."""

    def __init__(self, provider: str, model: str, post: Callable[[str, str], str]):
        if provider not in _STYLES:
            raise ValueError(f"unsupported provider: {provider}")
        self.provider, self.model, self.post = provider, model, post

    def __call__(self, text: str, lang: str) -> tuple:
        body = request_body(self.provider, self.model, text, lang)
        return read_reply(self.provider, json.loads(self.post(self.provider, json.dumps(body))))


def get_service(provider: str, model: str, post: Callable[[str, str], str]) -> ProviderAdapter:
    """Registry lookup; unknown names raise ``ValueError``."""
    return ProviderAdapter(provider, model, post)
