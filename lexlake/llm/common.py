"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# one word: anything but space, tab, line feed, vertical tab, form feed and carriage return
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's digits modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def in_fold(doc_id: Column, folds: int, number: int) -> Column:
    """Whether an id belongs to a fold; rows without an id belong to none."""
    return F.coalesce(fold(doc_id, folds) == number, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8; bytes are split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]):
    """A function for ``mapInArrow`` that sets up once per task and then maps batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield step(batch)

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts of a batch one by one, so that no second copy of all of them is held."""
    for value in batch.column(name):
        yield value.as_py()
