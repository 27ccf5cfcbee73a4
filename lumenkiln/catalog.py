"""Versioned Parquet snapshots: whole new file sets are written, then a commit file names them.

Plain Parquet has no MERGE, so a merge is a function from frames to frames, and its result becomes version n + 1.  Every writer writes to
folders of its own, and the commit file of a version, which only one writer can create, says which folders are the version's tables.
So readers see all of a commit or nothing, and a writer that comes second harms nothing; a phase is done if its marker is there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        """Numbers of all commit files, the latest first; one that is still empty was begun but not ended."""
        here = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(here)] if self._fs.exists(here) else []
        return sorted((int(n[len("_commit-"):]) for n in names if n.startswith("_commit-")), reverse=True)

    def _tables(self, version: int) -> dict[str, str] | None:
        """The folder of each table as of a version, None if it was not ended."""
        stream = self._fs.open(self._path(f"{self.root}/_commit-{version}"))
        try:
            text = self._text.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def version(self) -> int:
        """The committed version, 0 for none."""
        return next((n for n in self._commits() if self._tables(n) is not None), 0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version: what the latest commit at or before it names."""
        for n in self._commits():
            tables = self._tables(n) if version is None or n <= version else None
            if tables is not None:
                if table not in tables:
                    break
                return self.spark.read.parquet(f"{self.root}/{tables[table]}")
        raise LookupError(f"no version of {table}")

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables to new folders, then publish them as the next version; a writer that comes second for a version fails."""
        before = self.version()
        at = max(self._commits(), default=0) + 1
        named = dict(self._tables(before) or {}) if before else {}
        for name, frame in tables.items():
            named[name] = f"{name}/{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.root}/{named[name]}")
        self._publish(before, at, named)
        return at

    def _publish(self, before: int, at: int, named: dict[str, str]) -> None:
        """Creates the commit file; fails if any other writer did since ``before`` was read."""
        try:
            if self.version() != before:
                raise RuntimeError(f"version {at} is committed by another writer")
            out = self._fs.create(self._path(f"{self.root}/_commit-{at}"), False)
        except Exception as e:
            raise RuntimeError(f"version {at} is committed by another writer") from e
        out.write(bytearray(json.dumps(named).encode()))
        out.close()

    def done(self, phase: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/_phase-{phase}"))

    def mark(self, phase: str) -> None:
        self._fs.createNewFile(self._path(f"{self.root}/_phase-{phase}"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Old rows merged with new ones by key.

    Policies by column: overwrite (new value), keep (old value of known rows), coalesce_old (fill gaps), coalesce_new (new unless null).  The default is overwrite.
    """
    from pyspark.sql import functions as F

    rest = [c for c in old.columns if c not in keys]
    incoming = new.select(*keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"_in_{c}") for c in rest])
    rows = old.withColumn("_had", F.lit(True)).join(incoming, keys, "full")

    def value(c: str):
        o, n = F.col(c), F.col(f"_in_{c}")
        return {
            "overwrite": F.when(F.col("_in"), n).otherwise(o), "keep": F.when(F.col("_had"), o).otherwise(n), "coalesce_old": F.coalesce(o, n), "coalesce_new": F.coalesce(n, o),
        }[policy.get(c, "overwrite")]

    return rows.select(*keys, *[value(c).alias(c) for c in rest]).select(*old.columns)
