"""Model calls as rows in, rows out. A provider takes key, prompt, temperature and attempt, and adds text (null where the
call failed). Operators never call one on the path of a checked query."""

from __future__ import annotations

import json
import os
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(ABC):
    @abstractmethod
    def complete(self, requests: DataFrame) -> DataFrame:
        """requests: prompt, optionally system, temperature, attempt, and any keys. Adds text."""


@dataclass
class TableProvider(Provider):
    """Completions looked up in a table (prompt_md5, attempt, text)."""

    completions: DataFrame

    def complete(self, requests: DataFrame) -> DataFrame:
        if "attempt" not in requests.columns:
            requests = requests.withColumn("attempt", F.lit(0))
        keyed = requests.withColumn("prompt_md5", F.md5("prompt"))
        return keyed.join(self.completions.select("prompt_md5", "attempt", "text"), ["prompt_md5", "attempt"], "left").drop("prompt_md5")


@dataclass
class RuleProvider(Provider):
    """A deterministic completion as an expression over the request's columns."""

    rule: Column

    def complete(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("text", self.rule)


_LOADED: dict[str, Callable[[list[str]], list[str | None]]] = {}


@dataclass
class LocalProvider(Provider):
    """A model loaded once per Python worker. load returns a function from prompts to texts; key names it in the cache."""

    key: str
    load: Callable[[], Callable[[list[str]], list[str | None]]]

    def complete(self, requests: DataFrame) -> DataFrame:
        key, load = self.key, self.load
        schema = requests.schema.simpleString()[len("struct<") : -1]

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from loomline.sources import providers

            if key not in providers._LOADED:
                providers._LOADED[key] = load()
            for b in batches:
                texts = providers._LOADED[key](b.column("prompt").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

        return requests.mapInArrow(call, f"{schema}, text string")


# fixed values: endpoints, key variables and default models of the presets
PRESETS = {
    "deepseek": ("https://api.deepseek.com", "DEEPSEEK_API_KEY", "deepseek-chat"),
    "qwen": ("https://dashscope.aliyuncs.com/compatible-mode/v1", "QWEN_API_KEY", "qwen-plus"),
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY", "gpt-4o-mini"),
    "groq": ("https://api.groq.com/openai/v1", "GROQ_API_KEY", "llama-3.1-8b-instant"),
}


@dataclass
class HttpProvider(Provider):
    """An OpenAI-compatible chat endpoint. An unknown preset means the first one. Keys come from the environment of the
    executors and are never printed. Connections are made per batch, and a call that fails gives null."""

    preset: str = "deepseek"
    model: str | None = None
    timeout: float = 60.0
    max_tokens: int = 2048

    def complete(self, requests: DataFrame) -> DataFrame:
        base, key_name, default = PRESETS.get(self.preset, next(iter(PRESETS.values())))
        model, timeout, most = self.model or default, self.timeout, self.max_tokens
        for name, value in (("system", F.lit("")), ("temperature", F.lit(0.7))):
            if name not in requests.columns:
                requests = requests.withColumn(name, value)
        schema = requests.schema.simpleString()[len("struct<") : -1]

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = []
                for prompt, system, t in zip(*(b.column(c).to_pylist() for c in ("prompt", "system", "temperature"))):
                    messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
                    body = {"model": model, "messages": messages, "temperature": t, "max_tokens": most}
                    ask = urllib.request.Request(f"{base}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_name, '')}"})
                    try:
                        with urllib.request.urlopen(ask, timeout=timeout) as reply:
                            texts.append(json.load(reply)["choices"][0]["message"]["content"])
                    except (OSError, ValueError, KeyError, IndexError):
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

        return requests.mapInArrow(call, f"{schema}, text string")


def score_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Inference scores by table: pairs (premise, hypothesis) with entailment, neutral, contradiction where scored."""
    key = F.md5(F.concat_ws("\x1f", "premise", "hypothesis"))
    return pairs.withColumn("__k", key).join(scores.withColumnRenamed("pair_md5", "__k"), "__k", "left").drop("__k")


def overlap_scores(pairs: DataFrame) -> DataFrame:
    """A stub for tests, not an inference model: entailment is the share of the hypothesis' words that the premise has."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"(?U)\s+"))
    share = F.size(F.array_intersect(words("premise"), words("hypothesis"))) / F.size(words("hypothesis"))
    return pairs.withColumns({"entailment": share, "neutral": 1 - share, "contradiction": F.lit(0.0)})
