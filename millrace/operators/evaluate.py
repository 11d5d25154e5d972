"""Grouping and template accuracy of a parse against ground truth.

A truth event is exact if one parsed event has the same lines. That is decided by
counts: the lines common to both events are as many as either event has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rules import EQUIVALENT_PAIRS, rewritten


def _labelled(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """LineId, t (truth event) and p (parsed event) of the lines with a truth event."""
    known = truth.where("EventId is not null").select("LineId", F.col("EventId").cast("string").alias("t"))
    return known.join(parsed.select("LineId", F.col("EventId").cast("string").alias("p")), "LineId")


def exact_groups(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """p, t, n: parsed and truth event of every exact group, and its lines."""
    pairs = _labelled(truth, parsed).groupBy("t", "p").agg(F.count("*").alias("n"))
    t = pairs.groupBy("t").agg(F.sum("n").alias("t_n"))
    p = pairs.where("p is not null").groupBy("p").agg(F.sum("n").alias("p_n"))
    return pairs.join(t, "t").join(p, "p").where("n = t_n and n = p_n").select("p", "t", "n")


def grouping_accuracy(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: GA, PGA, RGA."""
    lines = _labelled(truth, parsed)
    totals = lines.agg(F.count("*").alias("lines"), F.countDistinct("p").alias("n_p"), F.countDistinct("t").alias("n_t"))
    exact = exact_groups(truth, parsed).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hit"), F.count("*").alias("groups"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return totals.crossJoin(exact).select(  # one row each
        share("hit", "lines").alias("GA"), share("groups", "n_p").alias("PGA"), share("groups", "n_t").alias("RGA")
    )


def equal_templates(groups: DataFrame, truth_templates: DataFrame, parsed_templates: DataFrame) -> DataFrame:
    """The exact groups whose templates are equal: as a listed pair, or after rewriting both."""
    p = parsed_templates.select(F.col("EventId").cast("string").alias("p"), F.col("EventTemplate").alias("p_template"))
    t = truth_templates.select(F.col("EventId").cast("string").alias("t"), F.col("EventTemplate").alias("t_template"))
    named = groups.join(p, "p").join(t, "t")
    pairs = groups.sparkSession.createDataFrame(EQUIVALENT_PAIRS, "p_template string, t_template string")
    listed = named.join(F.broadcast(pairs), ["p_template", "t_template"], "left_semi").select("p", "t", "n")  # a fixed list
    same = named.where(F.col("p_template").isNotNull()).where(rewritten("p_template") == rewritten("t_template"))
    return listed.union(same.select("p", "t", "n")).distinct()


def template_accuracy(truth: DataFrame, parsed: DataFrame, truth_templates: DataFrame, parsed_templates: DataFrame) -> DataFrame:
    """One row: PA, PTA, RTA. The shares of templates are of the template tables' rows."""
    equal = equal_templates(exact_groups(truth, parsed), truth_templates, parsed_templates)
    hit = equal.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    n_p = parsed_templates.agg(F.countDistinct("EventId").alias("n_p"))
    n_t = truth_templates.agg(F.countDistinct("EventId").alias("n_t"))
    total = _labelled(truth, parsed).agg(F.count("*").alias("total"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return hit.crossJoin(n_p).crossJoin(n_t).crossJoin(total).select(  # one row each
        share("lines", "total").alias("PA"), share("k", "n_p").alias("PTA"), share("k", "n_t").alias("RTA")
    )


def harmonic(a: str, b: str):
    """Harmonic mean, 0 where both parts are 0."""
    return F.coalesce(F.try_divide(2 * F.col(a) * F.col(b), F.col(a) + F.col(b)), F.lit(0.0))


def evaluate(truth: DataFrame, parsed: DataFrame, truth_templates: DataFrame, parsed_templates: DataFrame) -> DataFrame:
    """One row: GA, PGA, RGA, FGA, PA, PTA, RTA, FTA."""
    both = grouping_accuracy(truth, parsed).crossJoin(template_accuracy(truth, parsed, truth_templates, parsed_templates))
    return both.select("GA", "PGA", "RGA", harmonic("PGA", "RGA").alias("FGA"), "PA", "PTA", "RTA", harmonic("PTA", "RTA").alias("FTA"))
