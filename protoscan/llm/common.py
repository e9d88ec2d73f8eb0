"""Pieces shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.session import materialise, ship_package

__all__ = ["LOWER", "binary_text", "columns", "fields", "fold", "load", "map_batches", "materialise", "others", "pieces", "quoted", "ship_package", "with_key", "worker_state"]

#: ASCII letters to lower case; every other byte of UTF-8 stays. ``bytes.split()`` then cuts at 0x20 and 0x09-0x0D.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_text(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def fold(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % divisor


def with_key(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``text_key``, which with the id tells rows of equal id and different texts apart."""
    return df.withColumn("text_key", F.xxhash64(F.col(text)))


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of ``df`` but those that an operator reads or adds, whatever their case."""
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def fields(df: DataFrame, names: list[str], more: str) -> str:
    """A schema of the named columns of ``df`` and ``more``."""
    return ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema if f.name in names), more])


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, one row at least; bounds memory, not rows."""
    at = batch.schema.get_field_index(column)
    sizes = batch.column(at).nbytes
    if sizes <= limit:
        yield batch
        return
    begin = total = 0
    for i, value in enumerate(batch.column(at)):
        n = 0 if not value.is_valid else value.as_buffer().size
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


_STATE: dict = {}


def worker_state(key: tuple, make):
    """What a Python worker keeps between its tasks: one object, made by ``make``.

    Asking for another key closes and drops the one before, so operators that run after each other in
    the same worker do not add up in memory.
    """
    if key not in _STATE:
        for old in _STATE.values():
            getattr(old, "close", lambda: None)()
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def map_batches(df: DataFrame, function, schema: str, column: str) -> DataFrame:
    """``mapInArrow`` with ``function(batch) -> RecordBatch`` over slices of bounded text size."""

    names = df.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch.rename_columns(names), column):
                if part.num_rows:
                    yield function(part)

    return df.toDF(*(c.replace(".", "\uff0e") for c in names)).mapInArrow(run, schema)  # which takes a dot for a field
