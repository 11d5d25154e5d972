"""Similarity searches as token joins, so that only texts with a common token meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import alpha_tokens, example_tokens, lettered_tokens


def token_index(texts: DataFrame, key: str, text: str, tokens=alpha_tokens) -> DataFrame:
    """key, token, cnt: how often each token occurs in each text."""
    exploded = texts.select(key, F.explode(tokens(F.col(text))).alias("token"))
    return exploded.groupBy(key, "token").agg(F.count("*").alias("cnt"))


def _sized(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy(key).agg(F.sum("cnt").alias("n"))


def nearest_template(messages: DataFrame, templates: DataFrame, k: int = 1) -> DataFrame:
    """id, tid, score, rank: each message's ``k`` templates of greatest Dice score, ties to the smaller tid.

    ``messages`` (id, text) and ``templates`` (tid, text).
    """
    m, t = token_index(messages, "id", "text"), token_index(templates, "tid", "text")
    common = (
        m.join(t.withColumnRenamed("cnt", "t_cnt"), "token")
        .groupBy("id", "tid")
        .agg(F.sum(F.least("cnt", "t_cnt")).alias("common"))
    )
    sizes = common.join(_sized(m, "id"), "id").join(_sized(t, "tid").withColumnRenamed("n", "t_n"), "tid")
    scored = sizes.select("id", "tid", F.round(2 * F.col("common") / (F.col("n") + F.col("t_n")), 6).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "tid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pending_similarity(messages: DataFrame, pending: DataFrame) -> DataFrame:
    """id, pid, score: the pending message most like each message; the earliest of the best.

    Score: tokens of the message that the pending one has, over half of both lengths, rounded down.
    """
    m = messages.select("id", lettered_tokens(F.col("text")).alias("tokens"))
    p = pending.select("pid", lettered_tokens(F.col("text")).alias("p_tokens"))
    counts = m.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("cnt"))
    words = p.select("pid", F.explode(F.array_distinct("p_tokens")).alias("token"))
    common = counts.join(words, "token").groupBy("id", "pid").agg(F.sum("cnt").alias("common"))
    sized = common.join(m.select("id", F.size("tokens").alias("n")), "id").join(p.select("pid", F.size("p_tokens").alias("p_n")), "pid")
    half = F.expr("(n + p_n) div 2")
    scored = sized.where(half > 0).select("id", "pid", F.round(F.col("common") / half, 6).alias("score"))
    best = F.max_by(F.struct("pid", "score"), F.struct("score", -F.col("pid"))).alias("b")
    return scored.groupBy("id").agg(best).select("id", "b.pid", "b.score")


def example_index(examples: DataFrame, glue_digits: bool = True) -> DataFrame:
    """cand_id, token, times, weight of examples (id, content, template, contents: what the wildcards cover).

    A token's weight grows from 1 to 2 with the balance of the examples that hold it as
    a constant and as variable content; ``times`` is 2 where one example has it as both.
    """
    tokens = lambda c: F.array_distinct(example_tokens(c, glue_digits))
    variable = tokens(F.array_join("contents", " "))
    sides = examples.select("id", tokens(F.col("template")).alias("constant"), variable.alias("variable"))
    rows = sides.select("id", F.explode("constant").alias("token"), F.lit(1).alias("c"), F.lit(0).alias("v")).unionAll(
        sides.select("id", F.explode("variable").alias("token"), F.lit(0).alias("c"), F.lit(1).alias("v"))
    )
    per = rows.groupBy("id", "token").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    totals = per.groupBy("token").agg(F.sum("c").alias("cs"), F.sum("v").alias("vs"))
    weight = F.least("cs", "vs") / F.greatest("cs", "vs") + 1
    return per.join(totals, "token").select(F.col("id").alias("cand_id"), "token", (F.col("c") + F.col("v")).alias("times"), weight.alias("weight"))


def example_knn(messages: DataFrame, index: DataFrame, k: int = 3, glue_digits: bool = True) -> DataFrame:
    """id, cand_id, sim, rank: each message's ``k`` examples of greatest weighted Jaccard similarity.

    Tokens of the message count as often as they occur; unknown ones weigh 1. Prompts
    list the best last: order by falling rank.
    """
    words = messages.select("id", F.explode(example_tokens(F.col("text"), glue_digits)).alias("token"))
    weights = index.select("token", "weight").distinct()
    own = words.join(weights, "token", "left").groupBy("id").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("self"))
    totals = index.groupBy("cand_id").agg(F.sum(F.col("times") * F.col("weight")).alias("total"))
    counted = words.groupBy("id", "token").agg(F.count("*").alias("cnt"))
    shared = counted.join(index, "token").groupBy("id", "cand_id").agg(F.sum(F.col("cnt") * F.col("times") * F.col("weight")).alias("s"))
    scored = shared.join(own, "id").join(totals, "cand_id")
    sim = F.round(F.try_divide(F.col("s"), F.col("self") + F.col("total") - F.col("s")), 6)
    scored = scored.select("id", "cand_id", F.coalesce(sim, F.lit(0.0)).alias("sim"))
    # Where fewer than k share a token, the first examples fill up with similarity 0.
    first = F.broadcast(totals.orderBy("cand_id").limit(k).select("cand_id"))  # k rows
    blank = messages.select("id").distinct().crossJoin(first).select("id", "cand_id", F.lit(0.0).alias("sim"))
    scored = scored.unionAll(blank).groupBy("id", "cand_id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "cand_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
