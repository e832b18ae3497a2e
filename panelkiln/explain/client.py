"""A client for services that speak the common chat-completions protocol over HTTP."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass

from .card import Client, Retrying, Transient


@dataclass
class ChatClient:
    """url: the service's base address, to which /chat/completions is added. Settings that are not given come from PANELKILN_LLM_URL, PANELKILN_LLM_MODEL and PANELKILN_LLM_KEY."""

    url: str | None = None
    model: str | None = None
    key: str | None = None
    temperature: float = 0.2
    timeout: float = 120.0

    def _setting(self, name: str) -> str:
        found = getattr(self, name) or os.environ.get(f"PANELKILN_LLM_{name.upper()}")
        if not found:
            raise ValueError(f"no {name} for the language model: give one or set PANELKILN_LLM_{name.upper()}")
        return found

    def complete(self, system: str, user: str, max_tokens: int = 1024) -> str:
        said = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self._setting("model"), "max_tokens": max_tokens, "temperature": self.temperature, "messages": said}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self._setting('key')}"}
        request = urllib.request.Request(f"{self._setting('url').rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                got = json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code in (408, 409, 429) or e.code >= 500:
                raise Transient(f"status {e.code}") from e
            raise
        except urllib.error.URLError as e:
            raise Transient(str(e.reason)) from e
        return got["choices"][0]["message"]["content"] or ""


def live() -> Client:
    return Retrying(ChatClient())
