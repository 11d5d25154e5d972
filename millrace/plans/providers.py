"""Where templates for unknown messages come from."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

WILD = "<*>"


class Provider:
    """Proposes a template for a message, and tells whether two texts have the same template."""

    #: Whether prompts are made for it.
    prompted = False

    def template(self, message: str, prompt: str | None = None) -> str | None:
        raise NotImplementedError

    def same(self, message: str, template: str, prompt: str | None = None) -> bool:
        return False


class Heuristic(Provider):
    """Digits become wildcards. Needs nothing."""

    def template(self, message: str, prompt: str | None = None) -> str | None:
        return re.sub(r"\d+", WILD, message)


@dataclass
class Lookup(Provider):
    """Recorded answers; unknown messages fall back to digits."""

    templates: dict[str, str] = field(default_factory=dict)

    def template(self, message: str, prompt: str | None = None) -> str | None:
        return self.templates.get(message)


@dataclass
class Callback(Provider):
    """Any function from a prompt to an answer."""

    prompted = True
    ask: Callable[[str], str | None]

    def template(self, message: str, prompt: str | None = None) -> str | None:
        return self.ask(prompt or message)

    def same(self, message: str, template: str, prompt: str | None = None) -> bool:
        return "yes" in (self.ask(prompt or f"{message}\n{template}") or "").lower()


@dataclass
class Http(Callback):
    """A chat-completion endpoint; the first model that it lists answers, at temperature 0."""

    url: str = ""
    max_tokens: int = 512
    ask: Callable[[str], str | None] = None
    model: str | None = None

    def __post_init__(self) -> None:
        self.ask = self._complete

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            return json.load(answer)

    def _complete(self, prompt: str) -> str | None:
        self.model = self.model or self._call("models")["data"][0]["id"]
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": self.max_tokens, "n": 1}
        return self._call("chat/completions", body)["choices"][0]["message"]["content"]


def ask_all(ask: Callable, jobs: list[tuple], at_once: int = 50) -> list:
    """Answers to jobs (the arguments of ``ask``), at most ``at_once`` outstanding; a failed job gives None."""

    def one(job: tuple):
        try:
            return ask(*job)
        except Exception:  # noqa: BLE001  a provider's failure must not stop the others
            return None

    if len(jobs) < 2:
        return [one(job) for job in jobs]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(one, jobs))
