"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise, table

#: Rows of one Arrow batch: whole texts are passed on, so a batch stays small even where they are long.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch where Spark can bound them.
BATCH_BYTES = 8 << 20
#: Rows up to which a list of ids or keys is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: A class with one of so many parts of all rows is hot; there are at most so many hot classes.
HOT_PARTS = 1_000


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches that text operators exchange with Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark deletes the shuffled files of each query inside of the block as soon as it ends; for steps that are written out."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    arrow_limits(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[list, list], dict[str, Iterable]]],
    fields: list[tuple[str, str, pa.DataType]],
    keep: bool = False,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """One output row per input row, computed from the whole text in Arrow batches.

    ``make()`` runs once in each task and returns ``f(ids, texts)``; texts come as
    UTF-8 bytes (null: empty). ``fields``: name, Spark type, Arrow type of the
    new columns. With ``keep`` all the input's columns stay in front, and a new
    column takes the place of an input column of its name; else only the id stays.
    Columns in ``drop`` are not passed on.
    """
    arrow_limits(df.sparkSession)
    names = {n for n, _, _ in fields}
    passed = [c for c in df.columns if c not in names and c not in drop] if keep else [id_col]
    body = F.col(f"`{text_col}`").cast("binary").alias(fresh(df, "__text"))
    inner = df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{id_col}`").alias(fresh(df, "__id")), body)
    out = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed] + [f"`{n}` {t}" for n, t, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            ids = b.column(b.num_columns - 2).to_pylist()
            texts = [t or b"" for t in b.column(b.num_columns - 1).to_pylist()]
            got = f(ids, texts)
            new = [pa.array(got[n], type=t) for n, _, t in fields]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(passed))] + new, names=passed + [n for n, _, _ in fields])
        pa.default_memory_pool().release_unused()  # the worker lives on

    mapped = inner.mapInArrow(run, ", ".join(out))
    return mapped.select(*[F.col(f"`{c}`") for c in df.columns if c in passed or c in names],
        *[F.col(f"`{n}`") for n, _, _ in fields if n not in df.columns]) if keep else mapped


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_text(value) -> int:
    """crc32 of an integer id written as decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def crc_remainder(col: str, mod: int):
    """The same as a column."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def broadcast_if_few(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (narrow rows) marked for broadcast where there are at most ``most`` of them, else as they are."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def join_classes(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their class; ``classes`` has one row a key, and its rows' number in ``n``.

    The rows of a hot class would meet in one task of a shuffle join. There are at most
    HOT_PARTS such classes, whatever the table, so these are broadcast and only the
    other rows are shuffled.
    """
    classes = materialise(classes, "class-results")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(classes.where(F.col("n") > max(1, total / HOT_PARTS)))
    cold = classes.where(F.col("n") <= max(1, total / HOT_PARTS))
    return rows.join(hot.drop("n"), key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.drop("n"), key))
