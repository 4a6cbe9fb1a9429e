"""What the operators share: the shared scratch folder, text columns, and batches of bounded size."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import shared_folder

#: Characters that one numpy pass inside a task handles at once.
CHARS_PER_PASS = 2_000_000
#: Rows of an Arrow batch that are taken out of it at once.
ROWS_PER_PASS = 256


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body has it."""
    return F.transform(F.array(value), body)[0]


_held: dict[Hashable, object] = {}


def in_worker(name: Hashable, make: Callable[[], object]) -> object:
    """What make() gives, kept for the tasks that follow in this Python worker. Spark reuses workers over the stages of a
    job, so one thing is kept at a time: what another operator left goes first."""
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


def within_bytes(rows: DataFrame, by: str, size: str, order: list[str], most: int) -> DataFrame:
    """Of rows (a bounded number of them), those in ``order`` whose sizes add up to ``most`` at most, for each value of ``by``."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_so_far", F.sum(size).over(so_far)).where(F.col("_so_far") <= most).drop("_so_far")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named; nothing else of docs, so clashing names do no harm."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def passes(texts: list[str], most: int = CHARS_PER_PASS) -> Iterator[slice]:
    """Consecutive slices of texts that hold at most about ``most`` characters (one text at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def kept_rows(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """docs without the rows that keep (a mask for each Arrow batch) rejects; all columns pass as they are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS_PER_PASS):  # few rows at once are Python objects
                some = b.slice(at, ROWS_PER_PASS)
                yield some.filter(pa.array(keep(some), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs source[starts[i] : starts[i] + lengths[i]], one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return source[:0]
    shift = np.repeat(starts - (ends - lengths), lengths)
    shift += np.arange(ends[-1])
    return source[shift]


def offsets(lengths: Iterable[int]) -> np.ndarray:
    """0 and the running sums of lengths."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))])
