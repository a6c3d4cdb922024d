"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takemark.storage import saved, shared_dir

__all__ = ["SPACE_CLASS", "Scratch", "changes", "in_groups", "let", "member_test", "saved", "slices", "small_batches", "table", "words_of"]

#: The white space of every word definition here: space and the five control characters from tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one call in the shared folder. Leaving the ``with`` block deletes them; keep() is for the result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.paths)

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        """df, written once to the shared folder and read back: cuts lineage and outlives executors."""
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """saved(), for what the caller gets: it stays, as a checkpoint does."""
        out = self.saved(df, label)
        self.paths.pop()
        return out


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for what runs inside, since rows here are whole texts or sets."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def member_test(values: DataFrame, s: Scratch, bits: int = 24) -> Callable[[Column], Column]:
    """A test whether a hash may be among those of values, which has one column ``v`` of them. DataFrame functions only.

    The hashes mark bits of one array of fixed size (2 MB), which a scalar subquery hands to all tasks.
    With more values it lets more others through; none of values is ever left out.
    """
    at = values.select(F.pmod("v", F.lit(1 << bits)).alias("v"))
    marked = at.groupBy(F.shiftright("v", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    every = s.spark.range(1 << (bits - 6)).join(marked, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = s.saved(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")), "members")

    def test(hashed: Column) -> Column:
        place = F.pmod(hashed, F.lit(1 << bits))
        word = F.get(table.scalar(), F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order: its maximal runs outside SPACE_CLASS. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS, -1), "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little of a batch stands as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def changes(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def in_groups(names: tuple[str, ...], work):
    """A mapInArrow function: work(table) on parts of bounded size of rows sorted by names, none of which is cut inside a group."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts.append(batch)
            if sum(b.num_rows for b in parts) < 20_000 and sum(b.nbytes for b in parts) < 8 << 20:
                continue
            held = pa.Table.from_batches(parts)
            starts = np.flatnonzero(changes(*(np.asarray(held[c].combine_chunks()) for c in names)))
            if len(starts) > 1:
                yield work(held.slice(0, int(starts[-1])).combine_chunks())
                parts = held.slice(int(starts[-1])).to_batches()
        if sum(b.num_rows for b in parts):
            yield work(pa.Table.from_batches(parts).combine_chunks())

    return worked
