"""Calls to models and providers behind two small protocols, with deterministic stand-ins."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class MetadataProvider(Protocol):
    name: str

    def search(self, title: str) -> list[dict]: ...


class Echo:
    """Answers with the first sentence of the prompt's text as its one claim: for tests and dry runs."""

    def complete(self, prompt: str) -> str:
        text = prompt.rsplit("\n\n", 1)[-1]
        return json.dumps({"overview": [{"summary": re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0]}], "sections": [], "warnings": []}, ensure_ascii=False)


def parse_payload(text: str | None) -> dict | None:
    """The JSON object in a model's answer: the whole, its inner result, or from the first to the last brace."""
    if not text:
        return None
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        for key in ("structured_output", "result"):
            inner = value.get(key) if isinstance(value, dict) else None
            if isinstance(inner, dict):
                return inner
            if isinstance(inner, str) and (parsed := parse_payload(inner)):
                return parsed
        if isinstance(value, dict):
            return value
    return None


def extract_units(units: DataFrame, client: ModelClient, instruction: str, at_once: int = 2, attempts: int = 3) -> DataFrame:
    """unit_id, text -> unit_id, summaries, error, attempt: `at_once` calls in parallel; only failed units are asked again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for unit, text in zip(df["unit_id"], df["text"]):
                answer, error, n = None, None, 0
                for n in range(1, attempts + 1):
                    try:
                        answer = parse_payload(client.complete(f"{instruction}\n\n{text}"))
                        error = None if answer is not None else "no JSON"
                    except Exception as e:  # noqa: BLE001 - a failed call becomes a row
                        error = type(e).__name__
                    if error is None:
                        break
                said = [str(o.get("summary") or "").strip() for o in (answer or {}).get("overview") or [] if isinstance(o, dict)]
                rows.append((unit, [s for s in said if s], error, n))
            yield pd.DataFrame(rows, columns=["unit_id", "summaries", "error", "attempt"], dtype=object)

    return units.select("unit_id", "text").repartition(at_once).mapInPandas(run, "unit_id string, summaries array<string>, error string, attempt int")


def look_up(titles: DataFrame, provider: MetadataProvider, cache: DataFrame | None = None) -> DataFrame:
    """key, title, records of titles, asked of the provider only where the cache has no row for provider and plain title."""
    from scholiast.functions.text import plain_title

    keyed = titles.select("title", F.sha2(F.concat(F.lit(provider.name + "\0"), plain_title(F.col("title"))), 256).alias("key")).dropDuplicates(["key"])
    todo = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame([(k, t, json.dumps(provider.search(t), ensure_ascii=False)) for k, t in zip(df["key"], df["title"])], columns=["key", "title", "records"], dtype=object)

    asked = todo.select("key", "title").mapInPandas(run, "key string, title string, records string")
    return asked if cache is None else asked.unionByName(cache.select("key", "title", "records").join(keyed.select("key"), "key", "left_semi"))
