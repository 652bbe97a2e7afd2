"""Pluggable models as Python callables, and their caches (U1-U4, SRC13).

A model is a function of a list: texts to vectors, queries and texts to scores,
prompts to answers. Without one, deterministic stand-ins of ours are used. Equal
inputs are sent once, which takes the place of a cache inside a run; a table of
known answers takes that of one across runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.json_text import first_object

#: Inputs of one call.
BATCH = 64


def cache_key(model: Column | str, prompt: Column) -> Column:
    """SC24: the key of a model's answer to a prompt."""
    model = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat_ws("\u0000", model, prompt), 256)


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str]], name: str, known: DataFrame | None = None) -> DataFrame:
    """Prompts (prompt) with a JSON answer each; known answers (key, answer) are not asked for again.

    An answer that holds no JSON object is asked for once more; if that fails too, it is null.
    """
    asked = prompts.select("prompt").distinct().withColumn("key", cache_key(name, F.col("prompt")))
    new = asked if known is None else asked.join(known.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                found = [first_object(a) for a in model(part["prompt"].tolist())]
                again = [i for i, a in enumerate(found) if a is None]
                if again:
                    for i, a in zip(again, model([part["prompt"].iloc[i] for i in again]), strict=True):
                        found[i] = first_object(a)
                yield pd.DataFrame({"key": part["key"], "answer": found})

    fresh = new.mapInPandas(run, "key string, answer string")
    every = fresh if known is None else fresh.unionByName(known.select("key", "answer"))
    return prompts.withColumn("key", cache_key(name, F.col("prompt"))).join(every, "key", "left")


def vectors_of(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], dimensions: int) -> DataFrame:
    """Vectors of distinct texts (text, embedding); a model that returns others than asked for is refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                found = model(part["text"].tolist())
                if len(found) != len(part) or any(len(v) != dimensions for v in found):
                    raise ValueError("the model returned other vectors than asked for")
                yield pd.DataFrame({"text": part["text"], "embedding": found})

    return texts.select("text").distinct().mapInPandas(run, "text string, embedding array<double>")


def rerank_scores(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """RT13: scores of pairs (guild_id, query_id, id, query, text); a failed call scores nothing, so its order stays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                found = model(frame["query"].tolist(), frame["text"].tolist())
            except Exception:  # noqa: BLE001  any failure of a foreign model
                found = []
            if len(found) == len(frame):
                yield frame[["guild_id", "query_id", "id"]].assign(rerank=found)

    return pairs.select("guild_id", "query_id", "id", "query", "text").mapInPandas(run, "guild_id string, query_id string, id string, rerank double")
