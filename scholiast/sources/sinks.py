"""Writers: stage tables with their envelope, single JSON and text files, image assets, manifests."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, stage: str, version: str, input_hash: str, attempt: int = 1, status: str = "passed") -> None:
    """Write a stage's rows with who made them from what; rows of the same stage, version and input are replaced, so a retry repeats none."""
    sealed = df.withColumns({"stage": F.lit(stage), "stage_version": F.lit(version), "input_hash": F.lit(input_hash), "attempt": F.lit(attempt), "status": F.lit(status), "created_at": F.current_timestamp()})
    sealed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "stage_version", "input_hash").parquet(path)


def write_text(path: str, text: str) -> None:
    """Write a file in full or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def write_json(path: str, value: object) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Write image bytes to folder/id.ext, a folder all executors share; rows say where each went, empty ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for df in batches:
            out = []
            for i, ext, data in zip(df["id"], df["extension"], df["bytes"]):
                if data is not None and len(data):
                    name = f"{''.join(c if c.isalnum() or c in '-_.' else '_' for c in i)}.{''.join(c for c in (ext or 'bin') if c.isalnum()) or 'bin'}"
                    temp = f"{folder}/.{name}.{os.getpid()}"
                    with open(temp, "wb") as f:
                        f.write(data)
                    os.replace(temp, f"{folder}/{name}")
                    out.append((i, f"{folder}/{name}"))
            yield pd.DataFrame(out, columns=["id", "asset_path"], dtype=object)

    return images.select("id", "extension", "bytes").mapInPandas(run, "id string, asset_path string")


def canonical_digest(value: object, leave_out: tuple[str, ...] = ("created_at", "attempt", "cache_hit")) -> str:
    """SHA-256 of a value as JSON with sorted keys, run-dependent keys left out at every depth."""
    import hashlib

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in leave_out}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return hashlib.sha256(json.dumps(clean(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
