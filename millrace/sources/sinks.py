"""Writers of results, in forms that the readers read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; quotes are doubled, so any text survives."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue='""')


def write_structured(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parsed lines with EventId and EventTemplate, ordered by line within each file."""
    write_csv(df.sortWithinPartitions("LineId"), path, mode)


def write_templates(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """EventId, EventTemplate, Occurrences as one file: a row a template."""
    write_csv(df.select("EventId", "EventTemplate", "Occurrences").coalesce(1).sortWithinPartitions("EventId"), path, mode)


def transposed(results: DataFrame, key: str = "Dataset") -> DataFrame:
    """metric and one column per data set, from a row per data set."""
    metrics = [c for c in results.columns if c != key]
    long = results.unpivot(key, metrics, "metric", "value")
    return long.groupBy("metric").pivot(key).agg(F.first("value"))


def write_benchmark(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(transposed(results).coalesce(1), path, mode)


def write_examples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line."""
    df.coalesce(1).write.mode(mode).json(path)
