"""Versioned tables in a folder: new data is written beside the old, and one small file, made only if it doesn't exist yet, switches to it.

`<root>/versions/<number>` names, for each table, the Parquet folder that holds it, and the batches that are in. A commit that fails, or whose
tasks are lost, leaves folders that no version names. Of two commits on one version only one makes the next file; the other fails and may be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit made the next version."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getLen()) if self._fs.exists(folder) else []

    def version(self) -> int:
        """Number of the last version; 0 before the first commit."""
        return max(self._numbers(), default=0)

    def state(self, version: int | None = None) -> dict:
        """Tables and batches of a version: {"tables": {name: folder}, "batches": [...]}."""
        n = self.version() if version is None else version
        if not n:
            return {"tables": {}, "batches": []}
        stream = self._fs.open(self._path(f"{self.root}/versions/{n:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version (the last one if not told), or None if it has none."""
        folder = self.state(version)["tables"].get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def commit(self, tables: dict[str, DataFrame], batch: str | None = None) -> int:
        """Write the tables and switch to them; other tables stay. A batch that is in already changes nothing. Returns the version."""
        base = self.version()
        state = self.state(base)
        if batch is not None and batch in state["batches"]:
            return base
        for name, df in tables.items():
            folder = f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            state["tables"][name] = folder
        if batch is not None:
            state["batches"].append(batch)
        # complete under a name of its own first: the switch is one rename, which fails if the name is taken
        text, made = json.dumps(state), self._path(f"{self.root}/tmp/{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        target = self._path(f"{self.root}/versions/{base + 1:012d}")
        if self._fs.exists(target) or not self._fs.rename(made, target):
            raise Conflict(f"version {base + 1} of {self.root} exists")
        return base + 1
