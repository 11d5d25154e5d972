"""Messages matched with templates: over a trie, or as a join on expressions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import WILD, template_to_regex
from millrace.operators.trie import Trie
from millrace.staging import staged


def trie_match(df: DataFrame, trie: Trie, message: str = "message", name: str = "cid") -> DataFrame:
    """``df`` with the id of the template that each message matches, or null.

    The trie is broadcast: it grows with the number of templates, not of lines.
    """
    shared = df.sparkSession.sparkContext.broadcast(trie)

    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = shared.value
        for part in parts:
            yield pd.Series([None if m is None else tree.find(m) for m in part], dtype="Int64")

    find.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(find, "long")(message))


def anchor(template: Column) -> Column:
    """The longest token without a wildcard (the first of the longest), which every matching message has; else null."""
    constant = F.filter(F.split(template, " "), lambda t: (t != "") & ~F.contains(t, F.lit("<*>")))
    longest = F.array_max(F.transform(constant, lambda t: F.length(t)))
    return F.try_element_at(F.filter(constant, lambda t: F.length(t) == longest), F.lit(1))


def regex_match(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """id, tid: the least tid whose expression matches each message (id, text); unmatched ones are left out.

    A template (tid, template) meets the messages that have its anchor; only templates
    without any constant token meet all.
    """
    t = templates.select("tid", template_to_regex(F.col("template")).alias("regex"), anchor(F.col("template")).alias("anchor"))
    words = messages.select("id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("anchor"))
    keyed = words.join(t.where("anchor is not null"), "anchor").where(F.expr("text rlike regex")).select("id", "tid")
    free = messages.join(t.where("anchor is null").select("tid", "regex"), F.expr("text rlike regex")).select("id", "tid")
    return keyed.union(free).groupBy("id").agg(F.min("tid").alias("tid"))


class CoverIndex:
    """Keyed templates, found by what they have in common with one that may cover them.

    Where one template covers another both have the same spaces, and the tokens between
    them are equal or one of the two has a wildcard.
    """

    def __init__(self) -> None:
        self.tokens: dict[int, list[str]] = {}
        self.at: dict[tuple[int, int, str], set[int]] = defaultdict(set)

    @staticmethod
    def _places(tokens: list[str]) -> list[tuple[int, int, str]]:
        return [(len(tokens), i, WILD if WILD in t else t) for i, t in enumerate(tokens)]

    def put(self, key: int, template: str) -> None:
        self.drop(key)
        self.tokens[key] = template.split(" ")
        for place in self._places(self.tokens[key]):
            self.at[place].add(key)

    def drop(self, key: int) -> None:
        for place in self._places(self.tokens.pop(key, [])):
            self.at[place].discard(key)

    def candidates(self, template: str) -> list[int]:
        """Rising keys of the templates that may cover ``template`` or be covered by it."""
        tokens = template.split(" ")
        either = lambda n, i, t: (self.at.get((n, i, t), ()), self.at.get((n, i, WILD), ()))
        few = min((either(*p) for p in self._places(tokens) if p[2] != WILD), key=lambda e: len(e[0]) + len(e[1]), default=None)
        keys = [k for k, other in self.tokens.items() if len(other) == len(tokens)] if few is None else [*few[0], *few[1]]
        fits = lambda x, y: x == y or WILD in x or WILD in y
        return sorted(k for k in keys if all(map(fits, self.tokens[k], tokens)))


def cover_pairs(templates: DataFrame) -> DataFrame:
    """a, b (a < b): the pairs of different templates (tid, template) of which one covers the other.

    At least one of a pair has a wildcard. A template without any meets those whose rarest
    part it has: a part is an alphanumeric unit with the number of tokens and the token's
    place. Templates with wildcards meet where they share a part. Then tokens are compared
    in place, and what is left is aligned.
    """
    from millrace.functions.align import covers_udf
    from millrace.functions.text import word_units

    tokens = F.split("template", " ", -1)
    part = lambda n, i, w: F.concat_ws(" ", n.cast("string"), i.cast("string"), w)
    words = lambda t: F.filter(word_units(t, ""), lambda w: w.rlike("[a-zA-Z0-9]"))
    parts = F.flatten(F.transform("tokens", lambda t, i: F.transform(words(t), lambda w: part(F.size("tokens"), i, w))))
    known = templates.select("tid", "template", tokens.alias("tokens"), F.contains("template", F.lit(WILD)).alias("wild"))
    known = staged(known.withColumn("parts", F.array_distinct(parts)), "cover")
    facts = ["tid", "template", "tokens", "parts"]
    keyed = known.select(*facts, "wild", F.explode("parts").alias("part"))
    often = keyed.groupBy("part").agg(F.count("*").alias("n"))
    wild = keyed.where("wild")
    rarest = wild.join(often, "part").groupBy("tid").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    other = lambda df: df.select("part", *(F.col(c).alias(f"o_{c}") for c in facts))
    plain = wild.join(rarest, ["tid", "part"]).join(other(keyed.where("not wild")), "part")
    both = wild.join(other(wild), "part").where("tid < o_tid")
    both = both.where(F.col("part") == F.array_min(F.array_intersect("parts", "o_parts")))  # once a pair
    fits = F.forall(F.zip_with("tokens", "o_tokens", lambda x, y: (x == y) | F.contains(x, F.lit(WILD)) | F.contains(y, F.lit(WILD))), lambda ok: ok)
    pairs = plain.union(both.select(*plain.columns)).where(fits)
    return pairs.where(covers_udf("template", "o_template")).select(F.least("tid", "o_tid").alias("a"), F.greatest("tid", "o_tid").alias("b"))


def template_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """template, cid, is_new: the id of each new template; unknown ones are numbered on from the greatest id."""
    wanted = new.select("template").distinct()
    known = wanted.join(existing.groupBy("template").agg(F.min("cid").alias("cid")), "template", "left")
    top = existing.agg(F.coalesce(F.max("cid"), F.lit(-1)).alias("top"))
    fresh = known.where("cid is null").select("template", F.row_number().over(Window.orderBy("template")).alias("n"))
    numbered = fresh.crossJoin(top).select("template", (F.col("top") + F.col("n")).alias("cid"), F.lit(True).alias("is_new"))  # one row
    return known.where("cid is not null").select("template", "cid", F.lit(False).alias("is_new")).unionAll(numbered)
