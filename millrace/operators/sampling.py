"""Choosing diverse examples and their hard positives and negatives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.align import WILD, arrow_function, wild_align
from millrace.functions.distance import edit_distances
from millrace.functions.text import template_to_regex
from millrace.operators.relational import hash_sample, neighbourhood, prefix_sample
from millrace.staging import discard, staged


def farthest_points(texts: DataFrame, n: int, key: str = "id", text: str = "text") -> list[int]:
    """Keys of ``n`` texts, each the farthest by edit distance from those before; ties go to the smaller key.

    It starts from the smallest key. ``texts`` is a bounded sample (see ``hash_sample``);
    every step is one pass that keeps the distance to the chosen set.
    """
    now = staged(texts.select(F.col(key).alias("k"), F.col(text).alias("x"), F.lit(1 << 30).alias("d")), "farthest")
    first = now.orderBy("k").head()
    chosen: list[int] = []
    while first is not None and len(chosen) < n:
        chosen.append(first.k)
        nearer = staged(now.withColumn("d", F.least("d", F.levenshtein("x", F.lit(first.x)))), "farthest")
        discard(now)
        now = nearer
        first = now.where("d > 0").orderBy(F.desc("d"), "k").head()
    discard(now)
    return chosen


def example_pool(lines: DataFrame, rate: float, n: int, seed: int = 0) -> DataFrame:
    """A seeded sample of ``n`` lines of the first ``rate`` of all (LineId, ...)."""
    return hash_sample(prefix_sample(lines, rate), n, "LineId", seed)


def pairs_near(lines: DataFrame, queries: DataFrame, reach: int = 50, extra: int = 32, seed: int = 0) -> DataFrame:
    """Each query beside its candidates, each once: the lines up to ``reach`` places away and a seeded sample of ``extra`` lines.

    Both frames have id, text and template; candidates' columns have a leading ``n_``.
    """
    near = neighbourhood(queries, lines, "id", reach)
    drawn = hash_sample(lines, extra, "id", seed).select(*(F.col(c).alias(f"n_{c}") for c in lines.columns))
    far = queries.crossJoin(F.broadcast(drawn)).where(F.abs(F.col("id") - F.col("n_id")) > reach)  # `extra` rows
    return near.unionByName(far)


def _fits() -> Column:
    """Whether a candidate matches the query's template."""
    return F.expr("n_text rlike regex")


def hard_negatives(pairs: DataFrame) -> DataFrame:
    """id, n_id: the nearest candidate, by edit distance, that another template made and this one does not match."""
    other = with_regex(pairs.where(F.col("n_template") != F.col("template"))).where(~_fits())
    place = F.struct(F.levenshtein("text", "n_text"), "n_id")
    return other.groupBy("id").agg(F.min_by("n_id", place).alias("n_id"))


def hard_negatives_near(lines: DataFrame, queries: DataFrame, reach: int = 50, extra: int = 32, seed: int = 0) -> DataFrame:
    """id, n_id: the rows of ``hard_negatives(pairs_near(...))``, where queries are many and ids whole numbers, few alike.

    No pair becomes a row: a task takes a stretch of places with the lines around it and
    computes the distances of all its pairs together. The ``extra`` drawn lines pass the driver.
    """
    drawn = [tuple(row) for row in hash_sample(lines, extra, "id", seed).select(F.col("id").cast("long"), "text", "template").collect()]
    stretch = max(1, 8 * reach)
    start = lambda place: place - F.pmod(place, F.lit(stretch))
    place = F.col("id").cast("long")
    around = F.explode(F.sequence(start(place - reach), start(place + reach), F.lit(stretch).cast("long")))
    rows = queries.select(start(place).alias("_start"), F.lit(True).alias("asked"), place.alias("id"), "text", "template").unionAll(
        lines.select(around, F.lit(False), place, "text", "template")
    )

    def nearest(part: pa.Table) -> pa.Table:
        return _nearest_others(part, drawn, reach)

    found = rows.where("id is not null and template is not null").groupBy("_start").applyInArrow(nearest, "id long, n_id long")
    kept = lambda name, df: F.col(name).cast(df.schema["id"].dataType).alias(name)
    return found.select(kept("id", queries), kept("n_id", lines))


#: Queries whose candidates are compared together.
_TOGETHER = 50


def _nearest_others(rows: pa.Table, drawn: list[tuple[int, str | None, str | None]], reach: int) -> pa.Table:
    """id, n_id of the queries (``asked``) among ``rows``: id, text and template of a stretch of places."""
    rows = rows.sort_by("id")
    given = list(zip(rows["asked"].to_pylist(), *(rows[c].to_pylist() for c in ("id", "text", "template")), strict=True))
    asked = [row[1:] for row in given if row[0]]
    lines = [row[1:] for row in given if not row[0] and row[2] is not None]
    drawn = [row for row in drawn if None not in row]
    places = np.array([row[0] for row in lines], np.int64)
    best: dict[int, tuple[int, int]] = {}
    for at in range(0, len(asked), _TOGETHER):
        some = asked[at : at + _TOGETHER]
        first, last = np.searchsorted(places, some[0][0] - reach), np.searchsorted(places, some[-1][0] + reach, "right")
        for one, distance, n_id in _nearest(some, sorted([(*row, False) for row in lines[first:last]] + [(*row, True) for row in drawn]), reach):
            best[one] = min(best.get(one, (distance, n_id)), (distance, n_id))
    return pa.table({"id": pa.array(best, pa.int64()), "n_id": pa.array([n for _, n in best.values()], pa.int64())})


def _nearest(asked: list[tuple], others: list[tuple], reach: int) -> Iterator[tuple[int, int, int]]:
    """id, distance and n_id of each query's nearest candidate; the smaller id of the nearest.

    ``others`` (id, text, template, whether drawn) are in ascending order. A query without a text is alike far from all.
    """
    if not others:
        return
    names: dict[str, int] = {}
    ids, n_ids = (np.array([row[0] for row in side], np.int64) for side in (asked, others))
    made, n_made = (np.array([names.setdefault(row[2], len(names)) for row in side]) for side in (asked, others))
    gap = np.abs(ids[:, None] - n_ids)
    fair = (gap > 0) & ((gap <= reach) | np.array([row[3] for row in others])) & (made[:, None] != n_made)
    far = np.iinfo(np.int64).max
    distances = np.where(fair, edit_distances([row[1] or "" for row in asked], [row[1] for row in others]), far)
    for (one, text, template), row in zip(asked, distances, strict=True):
        if text is None:
            row[row < far] = -1
        while row[k := int(row.argmin())] < far:
            if not fits(template, others[k][1]):
                yield one, int(row[k]), others[k][0]
                break
            row[k] = far


def fits(template: str, text: str) -> bool:
    """Whether a text matches the template: what ``rlike`` finds with ``template_to_regex``."""
    return text.startswith(template.partition(WILD)[0]) and _expression(template).match(text) is not None


@lru_cache(4096)
def _expression(template: str) -> re.Pattern:
    """The template's expression; a dot and the end take the same line ends as Java's."""
    parts = [re.escape(part) for part in template.split(WILD)]
    return re.compile("[^\n\r\x85\u2028\u2029]+".join(parts) + r"(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z")


def hard_positives(pairs: DataFrame) -> DataFrame:
    """id, n_id: the farthest candidate of the same template."""
    same = with_regex(pairs.where(F.col("n_template") == F.col("template"))).where(_fits())
    place = F.struct(F.levenshtein("text", "n_text"), -F.col("n_id"))
    return same.groupBy("id").agg(F.max_by("n_id", place).alias("n_id"))


def with_regex(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("regex", template_to_regex(F.col("template")))


def synth_positive(template: str, message: str, seed: int = 0) -> str:
    """The message with other digits where the template has wildcards; the same seed gives the same digits."""
    fitted, contents, _ = wild_align(template, message)
    pieces = fitted.split("<*>")
    out, place = pieces[0], seed
    for content, after in zip(contents, pieces[1:], strict=False):
        for c in content:
            place = (place * 31 + 7) % 1_000_003
            out += str((int(c) + 1 + place % 9) % 10) if c.isdecimal() else c
        out += after
    return out


def _synth_series(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for template, message, seed in parts:
        yield pd.Series([synth_positive(*row) for row in zip(template, message, seed.tolist(), strict=True)], dtype=object)


#: ``synth_positive`` of (template, message, seed) columns.
synth_positive_udf = arrow_function(_synth_series, "string", 3, pd.Series)
