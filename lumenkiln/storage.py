"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and everything runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/lumenkiln-shared"
    return at.rstrip("/")


#: The folder of this process's tables, by application: what `release` removes.
_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in this application's folder."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/lumenkiln/{app}-{uuid.uuid4().hex}"
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a command go when it ends, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: So many folders are written side by side; rows for more are sorted by folder first.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def durable(spark: SparkSession, df: DataFrame, name: str, *, small: bool = False, by: str | None = None, to: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so lost executors cost no recomputation.

    The schema is the frame's own, so an empty result reads back too.  ``small`` is for tables of whole manifests: packed
    more tightly, and the write's shuffle files are removed with it.  ``by``, the last column, gives each of its values a folder
    that `discard_parts` can remove.  ``to``: the rows are added to this table, which is read anew.
    """
    at = to._lumenkiln_table if to is not None else scratch(spark, name)
    out = df.write.mode("append") if to is not None else df.write
    if by:
        out = out.partitionBy(by)
    if small:
        before = {k: spark.conf.get(k, None) for k in (_TIDY, _WRITERS)}
        spark.conf.set(_TIDY, "true")
        spark.conf.set(_WRITERS, "16")
        try:
            out.option("compression", "zstd").parquet(at)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    else:
        out.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._lumenkiln_table = at
    return back


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def size_of(table: DataFrame) -> int:
    """Bytes of a table that `durable` wrote."""
    return bytes_at(table.sparkSession, table._lumenkiln_table)


def bytes_at(spark: SparkSession, at: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    files, path = _path(spark, at)
    return files.getContentSummary(path).getLength()


def _remove(spark: SparkSession, at: str) -> None:
    files, path = _path(spark, at)
    files.delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `durable` wrote and that nothing reads any more: what came of them is written itself."""
    for df in tables:
        _remove(df.sparkSession, df._lumenkiln_table)


def discard_parts(table: DataFrame, by: str, values: list[int]) -> None:
    """Remove the parts of a table written ``by`` a column that have these values."""
    for v in values:
        _remove(table.sparkSession, f"{table._lumenkiln_table}/{by}={v}")


def release(spark: SparkSession) -> None:
    """Remove all tables that this application wrote; results that were not written elsewhere can't be read afterwards."""
    at = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if at:
        _remove(spark, at)
