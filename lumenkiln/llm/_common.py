"""What the corpus operators share: table access, durable cuts of lineage, keys."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import discard, durable, release  # noqa: F401  the operators take them from here

#: Every ASCII byte that is no letter or digit becomes a space, A-Z becomes a-z; other bytes stay.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, where the session has Spark's default: whole texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def keyed(spark: SparkSession, df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """The columns named and ``_key`` (long, unique, in the order of id_col).

    Ids that are unique and not null are their own keys, and id_col is left out.  Otherwise the rows
    are sorted by id (nulls first) and the columns (what has no order of its own, as a map, by its JSON), numbered,
    and written once, so each row of a repeated id is a document of its own and keeps one number throughout.
    """
    bound_batches(spark)
    df = df.select(id_col, *columns)
    odd = df.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull())
    if not odd.limit(1).take(1):
        return df.select(F.col(id_col).cast("long").alias("_key"), *columns).filter("_key is not null")
    plain = {f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))}
    order = [F.col(id_col).asc_nulls_first(), *[(F.col(c) if c in plain else F.to_json(F.struct(c))).asc_nulls_first() for c in columns]]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(spark, ranged.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def give_back() -> None:
    """Hands memory that a worker has freed back to the machine: workers live on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # there is no malloc_trim outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """A function over batches that gives back what it has freed when it is through."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def others(docs: DataFrame, text_col: str) -> Column:
    """The columns of docs but the text, as a struct ``row`` (with a placeholder where there are none)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return F.struct(*(rest or [F.lit(0).alias("none")])).alias("row")


def restored(docs: DataFrame, text_col: str, text: Column | str = "text") -> list[Column]:
    """The columns of docs again, from ``row`` and the text given."""
    return [(F.col(text) if isinstance(text, str) else text).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]


def annotated(docs: DataFrame, work, ddl: str, *, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """One result row per row of docs: ``id`` (or, with carry, the input's other columns as ``row`` and ``text``) and work's columns.

    work takes a list of texts (UTF-8 bytes or None) of bounded total size and
    returns one list per column of ddl.  Only id and text are read unless carry is set.
    """
    bound_batches(docs.sparkSession)
    kept = others(docs, text_col) if carry else F.col(id_col).alias("id")
    chosen = docs.select(kept, F.col(text_col).cast("string").alias("text"))
    fixed = 1 + carry
    schema = T.StructType([*chosen.schema.fields[:fixed], *T._parse_datatype_string(ddl).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[fixed:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for lo, hi in runs(lengths, 4 << 20):
                part = batch.slice(lo, hi - lo)
                found = work(part.column(1).cast(pa.binary()).to_pylist())
                columns = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:fixed], *columns], schema.names)

    return chosen.mapInArrow(frugal(run), schema)


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``most`` in sum, or single items."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if sizes:
        yield lo, len(sizes)
