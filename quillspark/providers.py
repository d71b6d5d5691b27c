"""Models behind protocols, with deterministic stand-ins that need no network.

A provider is a plain object that is shipped to the workers and called once for each
Arrow batch, so that a partition is a unit of concurrency and a batch one of transfer.
"""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vector import hash_embedding
from quillspark.runtime import ship


class ChatModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class RuleChat:
    """Answers by the first rule whose pattern is in the prompt."""

    def __init__(self, rules: list[tuple[str, str]], default: str = ""):
        self.rules, self.default = rules, default

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((a for p, a in self.rules if re.search(p, x, re.I)), self.default) for x in prompts]


class OverlapScorer:
    """Share of the query's words in the text: a stand-in for a cross-encoder."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            words = set(re.findall(r"\w+", q.lower()))
            out.append(len(words & set(re.findall(r"\w+", t.lower()))) / len(words) if words else 0.0)
        return out


class Transient(RuntimeError):
    """A failure that may pass: status 408, 429 or 5xx, or a broken connection."""

    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def with_retry(call: Callable[[], Any], attempts: int = 3, base: float = 0.5, cap: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call again after a transient failure: exponential waits with jitter, a short Retry-After is kept to."""
    for n in range(attempts + 1):
        try:
            return call()
        except Transient as e:
            if n == attempts:
                raise
            wait = min(cap, base * 2**n) * (1 + random.random() / 4)
            sleep(e.retry_after if e.retry_after is not None and e.retry_after < 30 else wait)
    raise AssertionError


class TokenCache:
    """A bearer token kept until a minute before it ends; one thread fetches it."""

    def __init__(self, fetch: Callable[[], tuple[str, float]], now: Callable[[], float] = time.time):
        self.fetch, self.now = fetch, now
        self.held: tuple[str, float] | None = None
        self.lock = threading.Lock()

    def __getstate__(self):
        return {"fetch": self.fetch, "now": self.now}

    def __setstate__(self, state):
        self.__init__(state["fetch"], state["now"])

    def get(self) -> str:
        with self.lock:
            if self.held is None or self.now() >= self.held[1] - 60:
                self.held = self.fetch()
            return self.held[0]

    def invalidate(self) -> None:
        self.held = None


def stream_text(lines: list[str]) -> str:
    """Text of server-sent events: ``data:`` lines up to ``[DONE]``; damaged ones are skipped."""
    out = []
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line[5:].strip()
        if body == "[DONE]":
            break
        try:
            out.append(json.loads(body)["choices"][0]["delta"].get("content") or "")
        except (ValueError, KeyError, IndexError):
            continue
    return "".join(out)


def chat_messages(history: list[dict]) -> list[dict]:
    """Role mapping of a conversation: tool results become ``function`` messages."""
    return [{**m, "role": "function" if m["role"] == "tool" else m["role"]} for m in history]


def finish_reason(code: str) -> str:
    return {"blacklist": "content_filter", "function_call": "tool_calls"}.get(code, code)


def complete(df: DataFrame, prompt: str, model: ChatModel, out: str = "reply") -> DataFrame:
    """Add the model's reply to each row; a batch that fails for good has null replies."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            try:
                yield pd.Series(with_retry(lambda s=s: model.complete(s.fillna("").tolist())), dtype=object)
            except Transient:
                yield pd.Series([None] * len(s), dtype=object)

    return df.withColumn(out, run(F.col(prompt)))


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, dimensions: int = 64, out: str = "vector") -> DataFrame:
    """Add a vector to each row: by the provider in batches, or by token hashes in the JVM."""
    if embedder is None:
        return df.withColumn(out, hash_embedding(F.col(text), dimensions))
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vectors = with_retry(lambda s=s: embedder.embed(s.fillna("").tolist()))
            if len(vectors) != len(s):
                raise ValueError(f"{len(vectors)} vectors for {len(s)} texts")
            yield pd.Series(vectors)

    return df.withColumn(out, run(F.col(text)))


def pair_scores(df: DataFrame, query: str, text: str, scorer: PairScorer, out: str = "pair_score") -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(list(zip(q.fillna(""), t.fillna("")))), dtype=float)

    return df.withColumn(out, run(F.col(query), F.col(text)))


def parse_entities(reply: str | None) -> dict:
    """Entities and relations of a reply: its outermost braces, or nothing if they hold no JSON."""
    m = re.search(r"\{.*\}", reply or "", re.S)
    try:
        data = json.loads(m[0]) if m else {}
    except ValueError:
        data = {}
    text = lambda x, d: str(x) if x else d
    entities = [
        {"id": text(e.get("id"), e["name"]), "type": text(e.get("type"), "Unknown"), "name": str(e["name"])} for e in data.get("entities") or [] if isinstance(e, dict) and e.get("name")
    ]
    known = {e["id"].lower() for e in entities}
    relations = [
        {"from_id": str(r["from"]), "to_id": str(r["to"]), "type": text(r.get("type"), "RELATED_TO")}
        for r in data.get("relations") or [] if isinstance(r, dict) and str(r.get("from", "")).lower() in known and str(r.get("to", "")).lower() in known
    ]
    return {"entities": entities, "relations": relations}
