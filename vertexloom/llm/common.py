"""Shared helpers: the shared folder, written tables, text columns, tokenizer files."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, file_system, fresh, shared_dir, stored_at

__all__ = ["Scratch", "file_system", "fresh", "shared_dir", "stored", "table", "text_or_empty", "tidied", "tokenizer_path"]


def tidy() -> None:
    """Hands memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, tidied up every so many batches and at the end: workers outlive tasks, and stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, b in enumerate(run(batches), 1):
                yield b
                if i % every == 0:
                    tidy()
        finally:
            tidy()

    return wrapped


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    return stored_at(df, fresh(df.sparkSession, tag), codec)


class Scratch:
    """Stored tables that are deleted together, once what is made of them has been stored elsewhere."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.number = spark, fresh(spark, tag), 0

    def stored(self, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
        self.number += 1
        return stored_at(df, f"{self.root}/{self.number}-{tag}", codec)

    def drop(self) -> None:
        dropped(self.spark, self.root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
