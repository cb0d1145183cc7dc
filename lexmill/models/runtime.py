"""External-model calls as a DataFrame stage: providers, limits, retries, usage and cost.

A stage sends each (system, user) row through ``call_model`` and returns the reply, its usage and the
error of rows that failed, so that one bad row stops nothing. Limits are global: a stage runs with a
bounded number of partitions, and each takes its share.
"""

from __future__ import annotations

import importlib
import json
import math
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.config import EngineConfig
from lexmill.operators.chunk import tokens_of

# Other names under which replies give their list of words.
WORD_KEYS = ("words", "vocabulary", "terms", "word_list", "words_list")
REPLY = "id string, payload string, input_tokens long, output_tokens long, measured boolean, error string"


class Provider(Protocol):
    """Returns (reply text, (input, output) tokens or None); raises on failure."""

    def __call__(self, system: str, user: str, max_tokens: int) -> tuple[str, tuple[int, int] | None]: ...


class Transient(Exception):
    """A failure that a later try may not meet."""


def is_transient(error: Exception) -> bool:
    text = f"{type(error).__name__} {error}".lower()
    return isinstance(error, (Transient, ConnectionError, TimeoutError)) or any(w in text for w in ("rate limit", "ratelimit", "429", "timeout", "timed out", "connection", "temporarily"))


def backoff(attempt: int) -> float:
    """5, 15, 45, then 90 seconds."""
    return float(min(5 * 3**attempt, 90))


@dataclass
class Limiter:
    """Rolling 60 second sums of tokens and requests; it waits once, until the oldest leaves."""

    tokens: int
    requests: int
    window: float = 60.0
    events: deque = field(default_factory=deque)

    def wait_needed(self, now: float, tokens: int) -> float:
        while self.events and self.events[0][0] <= now - self.window:
            self.events.popleft()
        spent = sum(n for _, n in self.events)
        over = (self.tokens > 0 and spent + tokens > self.tokens) or (self.requests > 0 and len(self.events) >= self.requests)
        return max(0.0, self.window - (now - self.events[0][0]) + 0.5) if over and self.events else 0.0

    def record(self, now: float, tokens: int) -> None:
        self.events.append((now, tokens))


def call_model(provider: Provider, system: str, user: str, config: EngineConfig, limiter: Limiter, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict:
    """One call with its waits and retries; retries within a call count as one request."""
    cost = tokens_of(system) + tokens_of(user)
    if (wait := limiter.wait_needed(clock(), cost + config.max_output_tokens)) > 0:
        sleep(wait)
    for attempt in range(config.max_retries + 1):
        try:
            payload, usage = provider(system, user, config.max_output_tokens)
            break
        except Exception as error:  # noqa: BLE001 - the row carries its error
            if attempt == config.max_retries or not is_transient(error):
                return {"payload": None, "input_tokens": 0, "output_tokens": 0, "measured": False, "error": f"{type(error).__name__}: {error}"[:500]}
            sleep(backoff(attempt))
    spent = usage or (cost, tokens_of(payload))
    limiter.record(clock(), sum(spent))
    return {"payload": payload, "input_tokens": spent[0], "output_tokens": spent[1], "measured": usage is not None, "error": None}


def model_stage(requests: DataFrame, provider: Provider, config: EngineConfig, partitions: int = 4) -> DataFrame:
    """Replies to rows (id, system, user). Write the result before reading it twice: calls cost money."""
    share = EngineConfig(**{**config.__dict__, "tokens_per_minute": math.ceil(config.tokens_per_minute / partitions), "requests_per_minute": math.ceil(config.requests_per_minute / partitions)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(share.tokens_per_minute, share.requests_per_minute)
        for batch in batches:
            rows = [{"id": r.id, **call_model(provider, r.system, r.user, share, limiter)} for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=["id", "payload", "input_tokens", "output_tokens", "measured", "error"])

    return requests.select(F.col("id").cast("string").alias("id"), "system", "user").repartition(partitions).mapInPandas(run, REPLY)


def stub_provider(system: str, user: str, max_tokens: int) -> tuple[str, tuple[int, int] | None]:
    """Offline and deterministic: answers in the shape that the system prompt names."""
    word = re.search(r"Word: (.*)", user)
    word = word[1].strip() if word else "text"
    if '"translation"' in system:
        return json.dumps({"translation": f"gloss of {word}", "hanja": ""}, ensure_ascii=False), None
    if '"sentences"' in system and "Number of sentences" in user:
        n = int(re.search(r"Number of sentences: (\d+)", user)[1])
        return json.dumps({"sentences": [f"**{word}** {i + 1}" for i in range(n)], "notes": f"use of {word}"}, ensure_ascii=False), None
    if '"sentences"' in system:
        lines = user.partition("Sentences:\n")[2].split("\n")
        return json.dumps({"sentences": [f"{line} **{word}**" for line in lines]}, ensure_ascii=False), None
    if '"patterns"' in system:
        found = sorted(set(re.findall(r"~\w+", user)))
        return json.dumps({"patterns": [{"pattern": p, "meaning": f"gloss of {p}", "explanation": "", "hanja": "", "examples": [{"target": f"**{p}** 1", "english": ""}]} for p in found]}, ensure_ascii=False), None
    if '"words"' in system:
        return json.dumps({"words": sorted(set(re.findall(r"\w+", user)))[:20]}, ensure_ascii=False), None
    return json.dumps({"notes": f"use of {word}"}, ensure_ascii=False), None


def parse_reply(payload: str | None) -> dict:
    """The object in a reply; fences, chatter and other names for ``words`` are tolerated; {} if none."""
    found = re.search(r"\{.*\}", re.sub(r"```\w*", "", payload or ""), re.DOTALL)
    try:
        out = json.loads(found[0]) if found else {}
    except ValueError:
        return {}
    if not isinstance(out, dict):
        return {}
    for name in WORD_KEYS[1:]:
        if name in out and "words" not in out:
            out["words"] = out.pop(name)
    return out


def words_of_reply(payload: Column) -> Column:
    """The list of words of a JSON reply, under any of its names; an empty list if there is none."""
    schema = ", ".join(f"{k} array<string>" for k in WORD_KEYS)
    parsed = F.from_json(payload, schema)
    return F.coalesce(*[parsed[k] for k in WORD_KEYS], F.array().cast("array<string>"))


def grammar_of_reply(payload: Column) -> Column:
    """The grammar items of a JSON reply that have a pattern and a meaning; an empty list if there are none."""
    item = "struct<pattern:string,meaning:string,explanation:string,hanja:string,examples:array<struct<target:string,english:string>>>"
    parsed = F.from_json(payload, f"patterns array<{item}>")["patterns"]
    usable = lambda g: (F.trim(F.coalesce(g["pattern"], F.lit(""))) != "") & (F.trim(F.coalesce(g["meaning"], F.lit(""))) != "")
    return F.coalesce(F.filter(parsed, usable), F.array().cast(f"array<{item}>"))


def load_provider(name: str) -> Provider:
    """The callable that ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise SystemExit(f"a provider is named module:attribute, not {name!r}")
    return getattr(importlib.import_module(module), attribute)


def exact_length(sentences: Column, n: int) -> Column:
    return F.size(sentences) == n


def usage_totals(replies: DataFrame) -> DataFrame:
    """One row: calls, measured and estimated ones, input and output tokens."""
    done = replies.filter("error IS NULL")
    row = done.agg(F.count("*").alias("calls"), F.count_if(F.col("measured")).alias("measured_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return row.withColumn("estimated_calls", F.col("calls") - F.col("measured_calls"))


def cost(input_tokens: Column, output_tokens: Column, prices: tuple[float, float] | None) -> Column:
    """Price of tokens in millions; null where nothing is priced."""
    if prices is None:
        return F.lit(None).cast("double")
    return input_tokens / 1_000_000 * F.lit(float(prices[0])) + output_tokens / 1_000_000 * F.lit(float(prices[1]))


@dataclass(frozen=True)
class Probe:
    name: str
    ok: bool
    detail: str = ""
    latency_ms: int | None = None


def diagnose(config: EngineConfig, provider: Provider | None, api_key: str = "", resolve: Callable[[str], str] | None = None, host: str = "") -> list[Probe]:
    """Probes of provider, key, configuration, name resolution and a call, in that order."""
    probes = [Probe("provider", True, config.provider), Probe("api_key", bool(api_key) or config.provider == "local", "set" if api_key else "missing"), Probe("config", not config.warnings, "; ".join(config.warnings))]
    try:
        probes.append(Probe("dns", True, resolve(host) if resolve and host else "skipped"))
    except OSError as error:
        probes.append(Probe("dns", False, str(error)))
    began = time.monotonic()
    try:
        if provider is not None:
            provider("ping", "ping", 1)
        probes.append(Probe("api_reachable", provider is not None, "" if provider else "no provider", int((time.monotonic() - began) * 1000)))
    except Exception as error:  # noqa: BLE001 - a probe reports
        probes.append(Probe("api_reachable", False, f"{type(error).__name__}: {error}"[:500]))
    return probes
