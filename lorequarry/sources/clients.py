"""Clients of model services over HTTP; injected where a model is called, never used by default.

Addresses, models and keys are parameters. A client is a callable ``(messages) -> str``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable


class APIError(Exception):
    """An answer other than success."""


def post(url: str, body: dict, key: str, timeout: float = 120, attempts: int = 5, least: float = 2, most: float = 10, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> dict:
    """JSON over HTTP; network errors and error answers are retried with growing waits."""
    if not key:
        raise ValueError("an API key is required")
    for attempt in range(attempts):
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with opener(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            failure: Exception = APIError(f"status {e.code}")
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            failure = e
        if attempt + 1 < attempts:
            sleep(min(most, max(least, 2.0**attempt)))
    raise failure


def chat(url: str, model: str, key: str, temperature: float = 0.7, **options) -> Callable[[list[dict]], str]:
    def call(messages: list[dict]) -> str:
        return post(url, {"model": model, "messages": messages, "temperature": temperature}, key, **options)["choices"][0]["message"]["content"]

    return call


def embeddings(url: str, model: str, key: str, **options) -> Callable[[list[str]], list[list[float]]]:
    def call(texts: list[str]) -> list[list[float]]:
        return [d["embedding"] for d in post(url, {"model": model, "input": texts}, key, **options)["data"]]

    return call
