"""Model clients: a protocol, retries, structured replies, and a fake."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from charloom.functions.rescue import first_object

TRANSIENT = (ConnectionError, TimeoutError, OSError)


class ModelClient(Protocol):
    def __call__(self, prompt: str) -> Any: ...


def flatten(content: Any) -> str:
    """Text of a reply: a string, a list of blocks, or an object with content."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "".join(flatten(b.get("text", "") if isinstance(b, dict) else b) for b in content)
    if content is None:
        return ""
    return flatten(getattr(content, "content", "")) if hasattr(content, "content") else str(content)


def with_retry(call: Callable[..., Any], attempts: int = 3, base: float = 1.0, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """Tries again after connection troubles only, each wait twice the last and a little more."""

    def run(*args: Any, **kw: Any) -> Any:
        for n in range(1, attempts + 1):
            try:
                return call(*args, **kw)
            except TRANSIENT:
                if n == attempts:
                    raise
                sleep(min(most, base * 2 ** (n - 1)) + random.uniform(0, 0.3))

    return run


def structured(reply: Any, check: Callable[[dict], Any]) -> Any:
    """A checked object out of a reply: its structured_response, else the first object in its messages, the last one first."""
    reply = reply if isinstance(reply, dict) else {"messages": [flatten(reply)]}
    own = reply.get("structured_response")
    if isinstance(own, dict):
        return check(own)
    for message in reversed(reply.get("messages") or []):
        found = first_object(flatten(message.get("content") if isinstance(message, dict) else message))
        if found is None:
            continue
        try:
            return check(json.loads(found))
        except Exception:
            continue
    raise ValueError(f"no usable object in the reply; it has {sorted(reply)}")


@dataclass
class FakeClient:
    """Answers by the first rule whose key is in the prompt; a reply may be a text, an object, an exception or a function."""

    rules: dict[str, Any] = field(default_factory=dict)
    default: Any = ""
    asked: list[str] = field(default_factory=list)

    def __call__(self, prompt: str) -> Any:
        self.asked.append(prompt)
        reply = next((r for k, r in self.rules.items() if k in prompt), self.default)
        if isinstance(reply, Exception):
            raise reply
        return reply(prompt) if callable(reply) else reply
