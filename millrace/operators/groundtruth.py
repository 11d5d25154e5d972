"""Ground truth from annotations, and events assigned to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import last_per_key, lookup

NO_TEMPLATE = "NO_TEMPLATE_FOUND"


def event_ids(lines: DataFrame) -> DataFrame:
    """EventTemplate, EventId ('E1'.. by first appearance), Occurrences of lines (LineId, EventTemplate)."""
    per = lines.groupBy("EventTemplate").agg(F.min("LineId").alias("first"), F.count("*").alias("Occurrences"))
    # One row a template.
    rank = F.row_number().over(Window.orderBy("first"))
    return per.select("EventTemplate", F.concat(F.lit("E"), rank.cast("string")).alias("EventId"), "Occurrences")


def build_groundtruth(lines: DataFrame, annotations: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Structured truth (LineId, Content, EventId, EventTemplate) and its templates.

    ``annotations`` (Content, EventTemplate, ``order``): the last row of a content holds.
    """
    table = last_per_key(annotations, "Content", "EventTemplate", order)
    found = lookup(lines.select("LineId", "Content"), table, "Content", "EventTemplate", NO_TEMPLATE)
    events = event_ids(found)
    structured = found.join(events.drop("Occurrences"), "EventTemplate")
    return structured.select("LineId", "Content", "EventId", "EventTemplate"), events.select("EventId", "EventTemplate", "Occurrences")


def assign_events(lines: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """``lines`` with EventId and EventTemplate of the cluster each belongs to, or -1 and an empty template.

    ``members`` (LineId, cid), ``clusters`` (cid, EventId, EventTemplate).
    """
    found = lines.join(members, "LineId", "left").join(clusters, "cid", "left").drop("cid")
    return found.withColumn("EventId", F.coalesce("EventId", F.lit(-1))).withColumn("EventTemplate", F.coalesce("EventTemplate", F.lit("")))


def template_counts(structured: DataFrame) -> DataFrame:
    """EventId, EventTemplate, Occurrences."""
    return structured.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("Occurrences"))
