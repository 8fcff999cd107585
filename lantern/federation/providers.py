"""Language models behind HTTP: any server that takes a JSON chat request and replies in JSON."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from .planning import FixedProvider, Provider


@dataclass
class Usage:
    """Tokens used so far, as the server counts them."""

    calls: int = 0
    prompt_tokens: int = 0
    reply_tokens: int = 0


@dataclass
class HttpProvider:
    """Posts {model, messages, max_tokens, temperature} to url and reads the reply at `reply_at`.

    reply_at and the two usage paths are keys and list places joined by dots, so servers of other
    shapes need no code. A request that the server refuses for now (429 and 5xx) is tried again.
    """

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    max_tokens: int = 512
    reply_at: str = "choices.0.message.content"
    prompt_tokens_at: str = "usage.prompt_tokens"
    reply_tokens_at: str = "usage.completion_tokens"
    seconds: float = 60.0
    tries: int = 3
    pause: float = 1.0
    usage: Usage = field(default_factory=Usage)

    def complete(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": 0}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.seconds) as reply:
                    data = json.load(reply)
                break
            except urllib.error.HTTPError as x:
                if n + 1 == self.tries or (x.code != 429 and x.code < 500):
                    raise
                time.sleep(self.pause * 2**n)
        self.usage.calls += 1
        self.usage.prompt_tokens += int(_at(data, self.prompt_tokens_at) or 0)
        self.usage.reply_tokens += int(_at(data, self.reply_tokens_at) or 0)
        text = _at(data, self.reply_at)
        if not isinstance(text, str):
            raise ValueError(f"no reply at {self.reply_at}")
        return text


def _at(data, path: str):
    for key in path.split("."):
        if isinstance(data, list) and key.isdigit() and int(key) < len(data):
            data = data[int(key)]
        elif isinstance(data, dict):
            data = data.get(key)
        else:
            return None
    return data


def from_environment(env: dict[str, str] | None = None) -> Provider:
    """The provider that LANTERN_LLM_URL, _MODEL, _KEY and _REPLY_AT describe; without a URL one that refuses."""
    env = os.environ if env is None else env
    url = env.get("LANTERN_LLM_URL")
    if not url:
        return FixedProvider("CANNOT_ANSWER")
    headers = {"Authorization": f"Bearer {env['LANTERN_LLM_KEY']}"} if env.get("LANTERN_LLM_KEY") else {}
    return HttpProvider(url, env.get("LANTERN_LLM_MODEL", "default"), headers, reply_at=env.get("LANTERN_LLM_REPLY_AT", "choices.0.message.content"))
