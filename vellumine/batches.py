"""Conversion of many files in batches, with progress, results as they come, and cancellation.

A batch is a share of the files by a hash of their paths. Its outputs are committed together, so a
folder holds whole batches at any time; a cancelled batch leaves nothing. Counts come from metrics
that Spark observes while it converts, not from a second pass.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellumine.convert import save
from vellumine.sources import files


@dataclass(frozen=True)
class Progress:
    """Files that are done and failed so far, of batches out of all."""

    done: int
    failed: int
    batches: int
    of: int
    cancelled: bool = False


class Conversion:
    """Batches as an iterator of (progress, rows of path, saved and error), each after its commit.

    ``cancel``, from any thread, ends the running batch and starts no other; ``progress`` is what
    is committed so far.
    """

    def __init__(self, found: DataFrame, target: str, folder: str, *, batches: int = 8, on_conflict: str = "rename", **options) -> None:
        self.found, self.target, self.folder, self.on_conflict, self.options = found, target, folder, on_conflict, options
        self.spark, self.tag, self.progress = found.sparkSession, f"vellumine-{uuid.uuid4().hex}", Progress(0, 0, 0, batches)
        self._stop = threading.Event()

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __iter__(self) -> Iterator[tuple[Progress, DataFrame]]:
        for k in range(self.progress.batches, self.progress.of):
            if not self._stop.is_set():
                context = self.spark.sparkContext
                context.addJobTag(self.tag)
                try:
                    saved = self._batch(k)
                except Exception:
                    if not self._stop.is_set():
                        raise
                finally:
                    context.removeJobTag(self.tag)
            if self._stop.is_set():
                self.progress = replace(self.progress, cancelled=True)
                return
            yield self.progress, saved

    def _batch(self, k: int) -> DataFrame:
        seen = Observation()
        mine = self.found.where(F.pmod(F.xxhash64("path"), F.lit(self.progress.of)) == k)
        counted = files.convert(mine, self.target, **self.options).observe(seen, F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        saved = save(counted, self.folder, self.target, self.on_conflict)
        p, n, failed = self.progress, seen.get["n"], seen.get["failed"]
        self.progress = replace(p, done=p.done + n - failed, failed=p.failed + failed, batches=p.batches + 1)
        return saved
