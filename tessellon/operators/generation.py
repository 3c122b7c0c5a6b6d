"""Asking a language model: prompts, calls with retries, summaries in batches. The model is any function of a prompt."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in an error's text after which a call is worth trying again.
TRANSIENT = ("429", "timeout", "timed out", "connection", "temporarily", "overloaded", "503", "502")


def prompts(asked: DataFrame) -> DataFrame:
    """(query_id, prompt) of asked (query_id, query, context, format): the question, what it may be answered from and, if there is one, the form that the answer must have. A null query has no prompt."""
    parts = [F.concat(F.lit("问题："), F.col("query")), F.concat(F.lit("资料：\n"), F.coalesce("context", F.lit("")))]
    if "format" in asked.columns:
        parts.append(F.when(F.col("format") != "", F.concat(F.lit("要求："), F.col("format"))))
    return asked.where("query is not null").select("query_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def back_off(attempt: int) -> float:
    """Seconds to wait after a failed attempt, counted from 0."""
    return float(attempt + 1)


def answers(asked: DataFrame, call: Callable[[str, int], str], tries: int = 3, wait: Callable[[int], float] = back_off, key: str = "query_id") -> DataFrame:
    """(key, answer, tries, error) of asked (key, prompt): call(prompt, attempt) in Arrow batches, again after errors that pass; an answer that never came is null with the last error."""
    if tries < 1:
        raise ValueError("there must be one try at least")

    def ask(prompt: str | None) -> tuple[str | None, int, str | None]:
        if prompt is None:
            return None, 0, "no prompt"
        for attempt in range(tries):
            try:
                return call(prompt, attempt), attempt + 1, None
            except Exception as e:  # noqa: BLE001 - told in the row
                error = f"{type(e).__name__}: {e}"
                if attempt + 1 == tries or not any(m in error.lower() for m in TRANSIENT):
                    return None, attempt + 1, error
                time.sleep(wait(attempt))
        raise AssertionError("unreachable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [ask(t) for t in p["prompt"]]
            yield pd.DataFrame({key: p[key].to_numpy(), "answer": [g[0] for g in got], "tries": [g[1] for g in got], "error": [g[2] for g in got]})

    return asked.select(key, "prompt").mapInPandas(run, f"{key} {dict(asked.dtypes)[key]}, answer string, tries int, error string")


def stand_in(prompt: str, attempt: int = 0) -> str:
    """What is answered without a model: the beginning of what was asked."""
    return "（未配置模型）" + prompt[:100]
