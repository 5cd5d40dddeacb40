"""Versioned tables in one folder: parts that are only added, and a log of what is live.

A version is one small file in ``log`` that names the live parts of each table. A change
writes new parts under names of their own, then commits by making the next version's file,
complete, under a name that nobody else has taken; who comes second reads the new version and
makes its change again. So readers never see half a change and builders lose nothing. The
commit needs a file system that makes a link or renames without replacing (local, HDFS).

Rows aren't rewritten by a change. Deletions are parts of identifiers, which hold for parts
of earlier versions (merge on read); changed rows of ``media`` are parts that overlay
earlier ones; document frequencies are signed runs that add up, merged by levels so that
their number grows with the logarithm of the changes. ``compact`` makes one part of each
table and forgets deletions; ``vacuum`` removes what no version kept names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import library as L

#: Runs of a level that are merged into one of the next.
FAN = 4
ATTEMPTS = 50


class Store:
    SHAPES = {
        "media": L.MEDIA,
        "fingerprints": "hash string, shingle_size int, media_id long, start_ms long, end_ms long",
        "streams": "media_id long, tokens array<string>, starts array<long>",
        "postings": "token string, media_id long, n long",
        "hash_df": "hash string, df long",
        "token_df": "token string, df long",
    }
    #: Tables in slots by a key; runs by their key.
    SLOTTED = {"fingerprints": "hash", "postings": "token"}
    RUNS = {"hash_df": "hash", "token_df": "token"}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- the log ------------------------------------------------------------------------

    def _folder(self, path: str):
        """(path, its file system) in Hadoop's terms."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def check_path(self) -> None:
        """Make the library's folder; an error at once, not after a long build, if it can't be."""
        folder, fs = self._folder(self.path)
        if fs.exists(folder) and not fs.getFileStatus(folder).isDirectory():
            raise ValueError(f"{self.path} is not a folder")
        try:
            made = fs.mkdirs(folder)
        except Exception as e:
            raise ValueError(f"cannot make the folder {self.path}") from e
        if not made:
            raise ValueError(f"cannot make the folder {self.path}")

    def versions(self) -> list[int]:
        folder, fs = self._folder(f"{self.path}/log")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict[str, Any]:
        """What is live in a version, the newest if none is named: for each table its parts
        with the version that added each (for runs, the level)."""
        known = self.versions()
        if not known:
            return {"version": 0, "top": 0, "deletes": [], **{n: [] for n in self.SHAPES}}
        target, fs = self._folder(f"{self.path}/log/{known[-1] if version is None else version:010d}.json")
        stream = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict[str, Any]) -> bool:
        """Whether ``state`` has become its version; no if another has."""
        name = f"{self.path}/log/{state['version']:010d}.json"
        draft, fs = self._folder(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        target, _ = self._folder(name)
        try:
            if fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            return fs.rename(draft, target)
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)

    def change(self, make: Callable[[dict[str, Any]], Any]) -> Any:
        """``make`` takes the newest state, writes parts and enters them; what it returns. A
        state that it leaves as it is needs no version. On a conflict it is called again."""
        for attempt in range(ATTEMPTS):
            state = self.state()
            before = json.dumps(state)
            state["version"] += 1
            result = make(state)
            if json.dumps(state | {"version": state["version"] - 1}) == before or self._commit(state):
                return result
            time.sleep(0.05 * attempt)
        raise RuntimeError(f"no commit to {self.path} in {ATTEMPTS} attempts")

    # -- parts --------------------------------------------------------------------------

    def put(self, name: str, df: DataFrame) -> str:
        """A new part; its name. Slotted tables are sorted by their key in each slot."""
        part = f"p{uuid.uuid4().hex}"
        path = f"{self.path}/{name}/part={part}"
        if key := self.SLOTTED.get(name):
            L.write_slotted(df, key, path)
        else:
            df.write.parquet(path)
        return part

    def parts(self, name: str, names: list[str], shape: str | None = None) -> DataFrame:
        """The rows of some parts, with ``part`` and, of slotted tables, ``slot``."""
        shape = (shape or self.SHAPES[name]) + (", slot int" if name in self.SLOTTED else "") + ", part string"
        if not names:
            return self.spark.createDataFrame([], shape)
        base = f"{self.path}/{name}"
        return self.spark.read.schema(shape).option("basePath", base).parquet(*[f"{base}/part={p}" for p in names])

    def _versioned(self, rows: DataFrame, entries: list[list[Any]], name: str) -> DataFrame:
        """``rows`` with the version of their part, which the log knows, as ``name``."""
        number = F.create_map(*[F.lit(x) for p, seq, *_ in entries for x in (p, seq)])
        return rows.withColumn(name, number[F.col("part")])

    def table(self, name: str, state: dict[str, Any] | None = None, slot: bool = False) -> DataFrame:
        """A table as it is now, or in ``state``; empty before the first build."""
        state = state or self.state()
        entries = state[name]
        rows = self.parts(name, [e[0] for e in entries])
        columns = [c.split()[0] for c in self.SHAPES[name].split(", ")]
        if key := self.RUNS.get(name):
            if len(entries) < 2:
                return rows.select(*columns)
            return rows.groupBy(key).agg(F.sum("df").alias("df")).where(F.col("df") != 0)
        gone = [d for d in state["deletes"] if name in d[2]]
        if entries and (gone or name == "media"):
            rows = self._versioned(rows, entries, "__seq")
        if entries and gone:
            marks = self._versioned(self.parts("deletes", [d[0] for d in gone], "media_id long"), gone, "__gone")
            marks = marks.groupBy("media_id").agg(F.max("__gone").alias("__gone"))
            rows = rows.join(marks, "media_id", "left").where(F.col("__gone").isNull() | (F.col("__seq") >= F.col("__gone")))
        if name == "media" and len(entries) > 1:
            rows = rows.groupBy("media_id").agg(F.max_by(F.struct(*columns), "__seq").alias("m")).select("m.*")
        return rows.select(*columns, *(["slot"] if slot else []))

    def add(self, state: dict[str, Any], name: str, df: DataFrame) -> None:
        state[name].append([self.put(name, df), state["version"]])

    def forget(self, state: dict[str, Any], gone: DataFrame, *names: str) -> None:
        """The rows of ``gone`` (media_id) in parts of earlier versions of some tables."""
        state["deletes"].append([self.put("deletes", gone.select("media_id").distinct()), state["version"], list(names)])

    def add_run(self, state: dict[str, Any], name: str, df: DataFrame) -> None:
        """A run of frequencies, negative for what goes; full levels are merged."""
        key, runs = self.RUNS[name], state[name]
        runs.append([self.put(name, df.select(key, F.col("df").cast("long").alias("df"))), 0])
        level = 0
        while len(full := [r for r in runs if r[1] == level]) >= FAN:
            merged = self.parts(name, [r[0] for r in full]).groupBy(key).agg(F.sum("df").alias("df")).where(F.col("df") != 0)
            runs[:] = [r for r in runs if r[1] != level] + [[self.put(name, merged), level + 1]]
            level += 1

    def compact(self) -> None:
        """One part for each table, without deleted rows and deletions."""

        def make(state: dict[str, Any]) -> None:
            whole = {n: self.table(n, state) for n in self.SHAPES}
            for name, df in whole.items():
                if name in self.RUNS:
                    top = max((r[1] for r in state[name]), default=0)
                    state[name] = [[self.put(name, df), top]]
                else:
                    state[name] = [[self.put(name, df), state["version"]]]
            state["deletes"] = []

        self.change(make)

    def vacuum(self, hours: float = 168.0, keep: int = 1) -> int:
        """Remove versions but the newest ``keep``, and parts that these don't name and that
        are older than ``hours`` (a running change may not have named its parts yet)."""
        known, gone = self.versions(), 0
        live = {e[0] for v in known[-keep:] for n, entries in self.state(v).items() if isinstance(entries, list) for e in entries}
        for version in known[:-keep]:
            target, fs = self._folder(f"{self.path}/log/{version:010d}.json")
            fs.delete(target, False)
        for name in (*self.SHAPES, "deletes"):
            folder, fs = self._folder(f"{self.path}/{name}")
            for found in fs.listStatus(folder) if fs.exists(folder) else []:
                part, old = found.getPath().getName().removeprefix("part="), time.time() * 1000 - found.getModificationTime()
                if part not in live and old >= 3600_000 * hours:
                    gone += fs.delete(found.getPath(), True)
        return gone
