"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.session import importable
from millrace.staging import discard, shared_dir, staged

__all__ = ["Marks", "WordHashes", "discard", "filter_texts", "load", "map_texts", "marked", "shared_dir", "signed", "staged", "values"]

#: Rows of a batch that are Python objects at a time.
ROWS = 512


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, read through Spark alone."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def signed(value: int) -> int:
    """The same 64 bits as a two's-complement long."""
    return value - (1 << 64) if value >> 63 else value


class WordHashes:
    """64-bit hashes of words (bytes), remembered for up to ``MOST`` words at a time."""

    MOST = 300_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            new = set(words).difference(known)
        if len(known) > self.MOST:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


class Marks:
    """A set of bits of fixed size, addressed by 64-bit keys: what is not marked is not in the set."""

    BITS = 1 << 24

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.uint64) & np.uint64(self.BITS - 1)
        return self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def marked(keys: DataFrame, key: Column) -> Marks:
    """The marks of a column of longs; at most BITS / 64 rows come to the driver, whatever the number of keys."""
    bit = key.bitwiseAND(F.lit(Marks.BITS - 1))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toPandas()
    table = np.zeros(Marks.BITS // 64, dtype=np.uint64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Marks(table)


def values(column: pa.Array) -> list:
    """A column as Python objects; strings go the faster way through numpy."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], list[tuple]]],
    schema: str,
    keys: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """Row-wise work in Arrow batches: rows of ``keys`` in, rows of ``schema`` out.

    ``make`` runs once a task and returns the function from some rows (tuples in the
    order of ``keys``) to output tuples; it gets at most ``ROWS`` rows at a time.
    """
    source = df.select(*keys)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = work(list(zip(*map(values, part.columns), strict=True)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return source.mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text") -> DataFrame:
    """The rows whose text is accepted, with all columns as they are, without a shuffle."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = make()
        for batch in batches:
            yield batch.filter(pa.array(accept(values(batch.column(at))), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
