"""Model calls as an operator: a provider is asked once per request, and its answers are written before use."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Anything picklable that turns a prompt into a response, or None when it can't."""

    def complete(self, prompt: str, attempt: int) -> str | None: ...


@dataclass(frozen=True)
class Stub:
    """A deterministic provider for tests and dry runs: templates filled by the hash of the prompt, one response in
    ``broken`` of them malformed."""

    templates: tuple[str, ...]
    broken: int = 7

    def complete(self, prompt: str, attempt: int) -> str | None:
        n = int(hashlib.md5(f"{prompt}:{attempt}".encode(), usedforsecurity=False).hexdigest()[:12], 16)
        if self.broken and n % self.broken == 0:
            return None if n % 2 else "I can't help with that."
        words = "amber brook cedar delta ember fjord grove haven islet jetty knoll larch meadow north orchard pier".split()
        picked = [words[(n >> (4 * i)) % len(words)] for i in range(6)]
        return self.templates[n % len(self.templates)].format(*picked, n=n % 1000)


@dataclass(frozen=True)
class ChatEndpoint:
    """An HTTP endpoint of the common chat-completions form."""

    url: str
    model: str
    temperature: float = 0.7
    max_tokens: int = 256
    timeout: float = 30.0

    def complete(self, prompt: str, attempt: int) -> str | None:
        if not self.url.startswith(("http://", "https://")):
            raise ValueError("the endpoint must be an http address")
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                return json.load(answer)["choices"][0]["message"]["content"]
        except (OSError, ValueError, KeyError, IndexError):
            return None


def answered(requests: DataFrame, provider: Provider, tries: int = 1, pause: float = 0.0, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """``requests`` (.., prompt) with ``response`` and ``attempts``; a missing response, or one that isn't ``wanted``, is
    asked for up to ``tries`` times, and the last one is kept.

    Write the result before using it twice: a plan that is run again asks again.
    """
    fields = requests.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            responses, attempts = [], []
            for prompt in frame["prompt"]:
                response, n = None, 0
                while n < tries and (response is None or wanted is not None and not wanted(response)):
                    if n and pause:
                        time.sleep(pause)
                    response, n = provider.complete(prompt, n), n + 1
                responses.append(response)
                attempts.append(n)
            yield frame.assign(response=responses, attempts=attempts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", response string, attempts bigint"
    return requests.mapInPandas(run, schema)


def endpoint_page(url: str) -> str:
    """Address of the metrics page that belongs to a serving address."""
    return url.rstrip("/").removesuffix("/v1") + "/metrics"


def fetched_page(url: str, timeout: float = 5.0) -> list[str] | None:
    """Lines of a page, or None if it can't be had."""
    if not url.startswith(("http://", "https://")):
        raise ValueError("the endpoint must be an http address")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode("utf-8", "replace").splitlines()
    except OSError:
        return None


def has_capacity(load: DataFrame, most_running: float = 0.0, most_waiting: float = 0.0) -> bool:
    """Is an endpoint's load (kind, load) within the limits? Without figures it counts as free."""
    limits = {"running": most_running, "waiting": most_waiting}
    return all(r.load is None or r.load <= limits.get(r.kind, float("inf")) for r in load.filter(F.col("kind").isin(*limits)).limit(10).collect())


def breaker_open(accepted: int, failed: int, longest_run: int, most: int) -> bool:
    """Should a loop stop? With nothing accepted after ``most`` failures, or after so many in a row."""
    return (accepted == 0 and failed >= most) or longest_run >= most
