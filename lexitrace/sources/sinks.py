"""Results as CSV and JSON; a short history of renames."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["filename", "episode_id", "title", "episode_title", "name_status", "suggested_filename", "confidence", "agreement", "method", "duration_s", "needs_review", "notes", "elapsed_s"]


def rows(results: DataFrame) -> DataFrame:
    """The thirteen columns of a report. ``agreement`` is votes/samples; files without a
    guess are UNKNOWN by method none, with 0/0. A batch has no time for a single file:
    ``elapsed_s`` is empty unless the results have it."""
    have = set(results.columns)
    if "agreement" not in have:
        shown = [F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in have else F.lit("0") for c in ("votes", "total_samples")]
        results = results.withColumn("agreement", F.concat(shown[0], F.lit("/"), shown[1]))
    told = {"episode_id": F.coalesce("episode_id", F.lit("UNKNOWN")), "method": F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("none")), "title": F.coalesce("title", F.lit(""))}
    results = results.withColumns({c: x for c, x in told.items() if c in have})
    return results.select(*[F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def write_csv(results: DataFrame, path: str) -> None:
    rows(results).write.mode("overwrite").csv(path, header=True)


def write_json(results: DataFrame, path: str) -> None:
    """JSON lines: one object for each row, written by all executors."""
    rows(results).write.mode("overwrite").json(path)


class RenameHistory:
    """Batches of renames in one small JSON file, the last ``most`` of them. A file that
    can't be read counts as empty."""

    def __init__(self, path: str, most: int = 50) -> None:
        self.path, self.most = path, most

    def batches(self) -> list[dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return []
        return found if isinstance(found, list) else []

    def _write(self, batches: list[dict]) -> None:
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(batches, f)
        os.replace(f"{self.path}.new", self.path)

    def push(self, destination: str, operations: list[dict]) -> None:
        batch = {"timestamp": time.time(), "destination": destination, "operations": operations}
        self._write([*self.batches(), batch][-self.most :])

    def peek(self) -> dict | None:
        return next(iter(self.batches()[-1:]), None)

    def pop(self) -> dict | None:
        found = self.batches()
        if not found:
            return None
        self._write(found[:-1])
        return found[-1]
