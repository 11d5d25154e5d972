"""Example sets for prompts: a diverse choice, then hard positives and negatives for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import prefix_sample
from millrace.operators.sampling import example_pool, farthest_points, hard_negatives, hard_positives, pairs_near, synth_positive_udf


def choose(truth: DataFrame, n: int = 32, rate: float = 0.2, pool: int = 1024, seed: int = 0) -> DataFrame:
    """content and template of ``n`` diverse lines among a seeded pool of the first ``rate`` of all.

    ``truth`` has LineId, Content, EventTemplate. The pool's size bounds what one
    distance pass compares.
    """
    drawn = example_pool(truth, rate, pool, seed).select(F.col("LineId").alias("id"), F.col("Content").alias("text"), F.col("EventTemplate").alias("template"))
    chosen = farthest_points(drawn, n)
    return drawn.where(F.col("id").isin(chosen)).select("id", F.col("text").alias("content"), "template")


def with_contrasts(examples: DataFrame, truth: DataFrame, rate: float = 0.2, reach: int = 50, extra: int = 32, seed: int = 0) -> DataFrame:
    """Examples (id, content, template) with Postive_Example and Negative_Example.

    Where no other line of the template is near, the positive is the example with other
    digits in its wildcards; without a negative that column is null.
    """
    lines = prefix_sample(truth, rate).select(F.col("LineId").alias("id"), F.col("Content").alias("text"), F.col("EventTemplate").alias("template"))
    asked = examples.select("id", F.col("content").alias("text"), "template")
    pairs = pairs_near(lines, asked, reach, extra, seed)
    texts = lines.select(F.col("id").alias("n_id"), F.col("text").alias("n_text"))
    positive = hard_positives(pairs).join(texts, "n_id").select("id", F.col("n_text").alias("p"))
    negative = hard_negatives(pairs).join(texts, "n_id").select("id", F.col("n_text").alias("Negative_Example"))
    found = examples.join(positive, "id", "left").join(negative, "id", "left")
    return found.select("content", "template", F.coalesce("p", synth_positive_udf("template", "content", "id")).alias("Postive_Example"), "Negative_Example")
