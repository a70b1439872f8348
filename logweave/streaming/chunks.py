"""Mining of a stream, chunk by chunk, with a state that is kept as Parquet."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import State, assignment, mine_chunk, prepare

PARTS = ("templates", "pending", "assigned")


class Snapshots:
    """Versions of a state in a folder: a version counts once its marker is there, so a crash leaves the one before."""

    def __init__(self, spark: SparkSession, folder: str, keep_minutes: float = 0.0) -> None:
        self.spark, self.folder, self.pause = spark, folder.rstrip("/"), keep_minutes * 60
        self.saved_at = 0.0

    def _marker(self):
        return f"{self.folder}/versions"

    def versions(self) -> list[int]:
        try:
            return sorted(json.loads(r.value)["version"] for r in self.spark.read.text(self._marker()).collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return []
            raise

    def load(self) -> State:
        found = self.versions()
        if not found:
            return State()
        return State(*[self.spark.read.parquet(f"{self.folder}/v{found[-1]}/{p}") for p in PARTS])

    def save(self, state: State, version: int) -> State:
        for p in PARTS:
            getattr(state, p).write.mode("overwrite").parquet(f"{self.folder}/v{version}/{p}")
        if version not in self.versions():
            self.spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("append").text(self._marker())
        self.saved_at = time.time()
        return self.load()

    def due(self, changed: bool) -> bool:
        """Whether to save now: on a change, else after the pause."""
        return changed or time.time() - self.saved_at >= self.pause


class StreamMiner:
    """``foreachBatch`` target: each batch is a chunk; ``finalize`` extracts what is pending and corrects templates."""

    def __init__(self, spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None] | None = None, **options) -> None:
        prepared = ("masker", "filters", "patterns", "user_strings")
        self.prepare_options = {k: v for k, v in options.items() if k in prepared}
        self.options = {k: v for k, v in options.items() if k not in prepared}
        self.snapshots, self.sink = Snapshots(spark, folder), sink
        self.state = self.snapshots.load()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.snapshots.versions()
        if batch_id in done or batch.isEmpty():
            return  # a repeated batch has been taken in already
        lines = prepare(batch, **self.prepare_options)
        self.state = self.snapshots.save(mine_chunk(lines, self.state, last=False, **self.options), batch_id)
        if self.sink:
            self.sink(assignment(lines, self.state), batch_id)

    def finalize(self) -> State:
        empty = prepare(self.snapshots.spark.createDataFrame([], "log_index long, content string"))
        versions = self.snapshots.versions()
        self.state = self.snapshots.save(mine_chunk(empty, self.state, last=True, **self.options), (versions[-1] if versions else -1) + 1)
        return self.state
