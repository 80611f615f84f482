"""Language models are plug-ins: anything with ``answer(system, user)``.  The default works offline."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T


#: Replies that are worth another call.
AGAIN = (429, 500, 502, 503, 504)


class ProviderError(RuntimeError):
    """A provider gave no usable reply; ``code`` says why, ``status`` is that of an HTTP reply."""

    def __init__(self, code: str, message: str = "", status: int | None = None):
        super().__init__(message or code)
        self.code, self.status = code, status


@dataclass(frozen=True)
class ModelConfig:
    """What a chat endpoint is called with."""

    model: str
    api_key: str = ""
    temperature: float | None = None
    max_tokens: int | None = None
    top_p: float | None = None

    def __post_init__(self) -> None:
        if not self.model.strip():
            raise ProviderError("not_configured", "a model must be named")

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})

    def payload(self, messages: list[dict[str, str]], stream: bool = False, **more: Any) -> dict[str, Any]:
        """The body of a call: what isn't given here or in the settings is left out."""
        named = {k: more.pop(k, None) for k in ("temperature", "max_tokens", "top_p")}
        known = {k: v if v is not None else getattr(self, k) for k, v in named.items()}
        return {"model": self.model, "messages": messages, "stream": stream} | {k: v for k, v in known.items() if v is not None} | more


def content_of(reply: Mapping[str, Any]) -> str:
    """The text of a reply in any of the known shapes."""
    choices = reply.get("choices")
    if isinstance(choices, list) and choices and isinstance(choices[0], Mapping):
        for part in ("message", "delta"):
            if isinstance(choices[0].get(part), Mapping) and "content" in choices[0][part]:
                return str(choices[0][part]["content"] or "")
        if "text" in choices[0]:
            return str(choices[0]["text"])
    for name in ("response", "text", "output", "result"):
        if name in reply:
            return str(reply[name])
    if isinstance(reply.get("data"), Mapping) and "content" in reply["data"]:
        return str(reply["data"]["content"])
    raise ProviderError("unexpected_response", f"no text in a reply with {sorted(reply)[:20]}")


class Provider(Protocol):
    def answer(self, system: str, user: str) -> str: ...


@dataclass
class Chat:
    """A provider over any function that sends a payload and returns the reply as a mapping; it holds no connection."""

    config: ModelConfig
    send: Callable[[dict[str, str], dict[str, Any]], Mapping[str, Any]]

    def answer(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return content_of(self.send(self.config.headers(), self.config.payload(messages)))


@dataclass
class Retrying:
    """Calls a provider again after failures that may pass: up to ``tries`` more times, waiting backoff, 2, 4, ... times backoff."""

    provider: Provider
    tries: int = 3
    backoff: float = 1.0
    wait: Callable[[float], None] = time.sleep

    def answer(self, system: str, user: str) -> str:
        for turn in range(self.tries + 1):
            try:
                return self.provider.answer(system, user)
            except ProviderError as error:
                if turn == self.tries or error.status not in AGAIN:
                    raise
                self.wait(self.backoff * 2**turn)
        raise AssertionError


def healthy(provider: Provider) -> bool:
    """Whether a provider answers at all."""
    try:
        provider.answer("", "ping")
        return True
    except Exception:  # whatever it raises, it isn't
        return False


class SelectAll:
    """Selects every piece of evidence that it is given."""

    def answer(self, system: str, user: str) -> str:
        return json.dumps({"evidence_ids": [e["id"] for e in json.loads(user)["evidence"]]})


class FirstBlock:
    """Answers with the content of the first context block."""

    def answer(self, system: str, user: str) -> str:
        return user.partition("[CONTENT]\n")[2].partition("\n[/")[0].strip()


def ask(prompts: DataFrame, provider: Provider, secrets: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, raw, provider_error) of each prompt (query_id, system, user); secrets are blotted out of replies.

    Tasks may run more than once, and so may calls; a provider with side effects must key them by query.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for q, system, user in zip(pdf["query_id"], pdf["system"], pdf["user"], strict=True):
                try:
                    rows.append((q, provider.answer(system, user), None))
                except ProviderError as error:
                    rows.append((q, None, error.code))
            yield pd.DataFrame(rows, columns=["query_id", "raw", "provider_error"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    said = prompts.select("query_id", "system", "user").mapInPandas(run, f"query_id {kind}, raw string, provider_error string")
    for secret in secrets:
        said = said.withColumn("raw", T.redact(F.col("raw"), secret))
    return said
