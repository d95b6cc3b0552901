"""Stages over DataFrames: cached by what they are made from, verified before they count, retried on failure.

A stage's key is a digest of its name, version, the fingerprints of the tables it reads
and the keys of the stages it depends on, so new data or a changed stage before it makes
it anew. Rows are written once, under a folder named by the key; a marker written after
the rows have been verified makes them count. A folder without marker is the rest of a
failed attempt and is overwritten.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scholiast.sources.sinks import canonical_digest


@dataclass(frozen=True)
class Stage:
    """transform makes the rows from the frames of the stages named in `after` and the tables named in `reads`.

    violations are the rows of broken rules: none may be left.
    """

    name: str
    version: str
    transform: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    violations: Callable[[DataFrame], DataFrame] | None = None
    reads: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


class StageFailed(RuntimeError):
    pass


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files, whatever the file system; of nothing if it is not there."""
    fs, root = _hadoop(spark, path)
    if not fs.exists(root):
        return canonical_digest([])
    files, found = fs.listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return canonical_digest(sorted(found))


@dataclass
class Runner:
    """Runs stages into root/<stage>/<version>/<key>; a stage whose key is there and marked is read, not made again."""

    spark: SparkSession
    root: str
    attempts: int = 3
    retry_on: tuple[type[Exception], ...] = (OSError, TimeoutError)
    log: list[dict] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)

    def key(self, stage: Stage, inputs: dict[str, str]) -> str:
        before = {name: self.keys[name] for name in stage.after}
        return canonical_digest({"stage": stage.name, "version": stage.version, "inputs": inputs, "after": before})

    def _marked(self, path: str) -> bool:
        fs, marker = _hadoop(self.spark, path + "/_VERIFIED")
        return fs.exists(marker)

    def _mark(self, path: str) -> None:
        fs, marker = _hadoop(self.spark, path + "/_VERIFIED")
        fs.create(marker, True).close()

    def run(self, stage: Stage, frames: dict[str, DataFrame], inputs: dict[str, str], force: bool = False) -> DataFrame:
        """The rows of a stage; frames are those of the stages before it, inputs the fingerprints of the tables it reads."""
        key = self.key(stage, inputs)
        self.keys[stage.name] = key
        path = f"{self.root}/{stage.name}/{stage.version}/{key}"
        if not force and self._marked(path):
            self.log.append({"stage": stage.name, "attempt": 0, "status": "cache_hit", "error": None})
            return self.spark.read.parquet(path)
        for n in range(1, self.attempts + 1):
            try:
                stage.transform(self.spark, {name: frames[name] for name in stage.after}).write.mode("overwrite").parquet(path)
                made = self.spark.read.parquet(path)
                if stage.violations is not None and (bad := stage.violations(made).limit(5).collect()):
                    raise StageFailed(f"{stage.name}: {[r.asDict() for r in bad]}")
                self._mark(path)
                self.log.append({"stage": stage.name, "attempt": n, "status": "passed", "error": None})
                return made
            except self.retry_on as e:
                self.log.append({"stage": stage.name, "attempt": n, "status": "failed", "error": type(e).__name__})
                if n == self.attempts:
                    raise StageFailed(f"{stage.name}: {type(e).__name__}") from e
                time.sleep(min(1.0, 0.1 * 2 ** (n - 1)))
        raise AssertionError("unreachable")
