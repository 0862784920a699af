"""A client for chat endpoints that speak the common completions form, over urllib."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from .client import flatten

#: Where a model name's first part says who serves it.
PROVIDERS = {"openai": "https://api.openai.com/v1", "deepseek": "https://api.deepseek.com/v1", "local": "http://127.0.0.1:8000/v1"}


@dataclass(frozen=True)
class HttpClient:
    """Plain data, so it travels to the tasks; `model` may be provider:name, and base_url goes before the provider's."""

    model: str
    api_key: str = ""
    base_url: str = ""
    temperature: float = 0.3
    timeout: float = 60.0

    def address(self) -> tuple[str, str]:
        provider, _, name = self.model.rpartition(":")
        base = self.base_url or PROVIDERS.get(provider or "openai")
        if not base:
            raise ValueError(f"no address for {provider!r}; give base_url")
        return f"{base.rstrip('/')}/chat/completions", name

    def __call__(self, prompt: str) -> str:
        url, name = self.address()
        body = {"model": name, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return flatten(json.loads(reply.read())["choices"][0]["message"]["content"])
        except urllib.error.HTTPError as e:
            # busy servers are worth another try, refusals aren't
            raise (ConnectionError if e.code in (408, 429) or e.code >= 500 else ValueError)(f"HTTP {e.code}") from e
