"""The template miner: match, join what is near, propose for the rest, reconcile, repeat.

Lines stay distributed. The driver holds the template dimension only: clusters with a
few facts each, the trie and the token indexes over them. Two schedules share one rule
book: ``learn`` takes messages one after another (the specification, for small data);
``mine`` works in rounds over distinct messages, one leader for each masked form.

A message with null Content counts as empty. A template that was ever learned stays in
the trie, and answers for the cluster that its own went into, so a message that has
matched always matches.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.functions.align import covers, merge_templates, wild_align, wild_align_udf, word_units
from millrace.functions.align import merge_wilds as merge_wilds_text
from millrace.functions.rules import correct_template, mask_common
from millrace.functions.text import WORD_MARKS, digit_fallback, has_constant, heuristic_template, is_single, merge_wilds, normalize_ws, unwrap_response
from millrace.operators.match import CoverIndex, trie_match
from millrace.operators.similarity import example_index, example_knn
from millrace.operators.trie import Trie
from millrace.plans.prompts import extract_text, merge_text
from millrace.plans.providers import Heuristic, Provider, ask_all
from millrace.staging import discard, staged

#: Leaders that one round looks at; the rest wait for the next round.
LEADERS = 500

_LETTER = re.compile("[a-zA-Z]")


@dataclass
class Cluster:
    """A template, and the cluster it went into, if it did.

    ``learned``: the (number, template, message) that the trie took up for it, numbered over all clusters.
    """

    cid: int
    template: str
    into: int | None = None
    learned: list[tuple[int, str, str]] = field(default_factory=list)


class TokenIndex:
    """Keyed bags of tokens, found by their tokens."""

    def __init__(self) -> None:
        self.sizes: dict[int, int] = {}
        self.having: dict[str, dict[int, int]] = defaultdict(dict)
        self.bags: dict[int, Counter] = {}

    def put(self, key: int, tokens: Counter) -> None:
        self.drop(key)
        self.bags[key], self.sizes[key] = tokens, tokens.total()
        for token, n in tokens.items():
            self.having[token][key] = n

    def drop(self, key: int) -> None:
        for token in self.bags.pop(key, ()):
            del self.having[token][key]
        self.sizes.pop(key, None)

    def dice(self, tokens: Counter, but: int | None = None) -> tuple[float, int | None]:
        """The greatest Dice similarity and its key, the least of the best; (0, None) without a common token."""
        common: Counter = Counter()
        for token, n in tokens.items():
            for key, m in self.having.get(token, {}).items():
                common[key] += min(n, m)
        common.pop(but, None)
        own = tokens.total()
        return max(((2 * c / (own + self.sizes[k]), k) for k, c in common.items()), key=lambda x: (x[0], -x[1]), default=(0.0, None))

    def overlap(self, tokens: Counter) -> float:
        """The greatest share of tokens that a bag has, by half of both sizes rounded down."""
        common: Counter = Counter()
        for token, n in tokens.items():
            for key in self.having.get(token, {}):
                common[key] += n
        own = tokens.total()
        return max((c / half for k, c in common.items() if (half := (own + self.sizes[k]) // 2)), default=0.0)


@dataclass
class Miner:
    """``threshold``: similarity above which an unknown message is compared with the nearest cluster, or waits for
    the template of one that is asked for already.

    ``generalise``: on a merge, whether the cluster takes the merged template; by default it
    keeps its own, as it always was, and only matching widens. ``generalise_many``: a new cluster and its
    nearest become one template, if with all clusters that it covers they are at least
    ``many`` for each wildcard more. ``examples`` (dicts with content, template, and
    perhaps positive and negative; a few dozen) are what prompts show, the ``k`` nearest
    to the message, best last.
    """

    provider: Provider = field(default_factory=Heuristic)
    threshold: float = 0.5
    generalise: bool = False
    generalise_many: bool = False
    many: int = 5
    examples: list[dict] = field(default_factory=list)
    k: int = 3
    shown: dict[str, list[dict]] = field(default_factory=dict)
    clusters: list[Cluster] = field(default_factory=list)
    trie: Trie = field(default_factory=Trie)
    direct: dict[str, int] = field(default_factory=dict)
    tokens: TokenIndex = field(default_factory=TokenIndex)
    shapes: CoverIndex = field(default_factory=CoverIndex)
    by_template: dict[str, int] = field(default_factory=dict)
    #: Questions for templates and for merges, rounds, and trie entries so far.
    asked: int = 0
    asked_same: int = 0
    rounds: int = 0
    entries: int = 0
    #: Counts lines, single tokens and lines without a cluster while the last result of ``mine`` is computed.
    observed: Observation | None = None

    # -- the template dimension -------------------------------------------------

    def root(self, cid: int) -> int:
        while self.clusters[cid].into is not None:
            cid = self.clusters[cid].into
        return cid

    def live(self) -> list[Cluster]:
        return [c for c in self.clusters if c.into is None]

    def find(self, message: str) -> int | None:
        cid = self.direct.get(message)
        cid = self.trie.find(message) if cid is None else cid
        return None if cid is None else self.root(cid)

    @staticmethod
    def alpha(text: str) -> Counter:
        return Counter(w for w in word_units(text, WORD_MARKS) if w.isalpha())

    @staticmethod
    def lettered(text: str) -> Counter:
        return Counter(w for w in word_units(text, WORD_MARKS) if _LETTER.search(w))

    def nearest(self, message: str, but: int | None = None) -> tuple[float, Cluster | None]:
        """The live cluster of greatest Dice similarity, the earliest of the best; ``but`` is left out."""
        score, cid = self.tokens.dice(self.alpha(message), but)
        return score, None if cid is None else self.clusters[cid]

    def _index(self, cluster: Cluster) -> None:
        self.tokens.put(cluster.cid, self.alpha(cluster.template))
        self.shapes.put(cluster.cid, cluster.template)
        self.by_template[cluster.template] = min(cluster.cid, self.by_template.get(cluster.template, cluster.cid))

    def _unindex(self, cluster: Cluster) -> None:
        self.tokens.drop(cluster.cid)
        self.shapes.drop(cluster.cid)
        if self.by_template.get(cluster.template) == cluster.cid:
            del self.by_template[cluster.template]

    def _learn(self, cid: int, template: str, message: str) -> None:
        """Let the trie find ``message``, and what is like it, for a cluster."""
        self.clusters[cid].learned.append((self.entries, template, message))
        self.entries += 1
        self._enter(cid, template, message)

    def _enter(self, cid: int, template: str, message: str) -> None:
        fitted, contents, _ = wild_align(template, message)
        self.trie.insert(fitted, contents, cid)
        if self.trie.find(message) is None:
            self.direct[message] = cid

    def accept(self, message: str, template: str) -> int:
        """The cluster of a message with its proposed template: a known one, or a new one that absorbs what it covers."""
        known = self.by_template.get(template)
        if known is not None:
            self._learn(known, template, message)
            return known
        new = Cluster(len(self.clusters), template)
        self.clusters.append(new)
        self._index(new)
        self._learn(new.cid, template, message)
        self._absorb(new)
        if self.generalise_many:
            self._generalise(new)
        return new.cid

    def _covered(self, template: str, but: Cluster) -> list[Cluster]:
        found = (self.clusters[cid] for cid in self.shapes.candidates(template) if cid != but.cid)
        return [c for c in found if covers(c.template, template)]

    def _take(self, new: Cluster, taken: list[Cluster]) -> None:
        for c in taken:
            c.into = new.cid
            self._unindex(c)

    def _absorb(self, new: Cluster) -> None:
        self._take(new, self._covered(new.template, new))

    def _generalise(self, new: Cluster) -> None:
        _, near = self.nearest(new.template, but=new.cid)
        if near is None:
            return
        merged = merge_wilds_text(merge_templates(near.template, new.template)[0])
        extra = merged.count("<*>") - near.template.count("<*>")
        taken = [near, *(c for c in self._covered(merged, new) if c is not near)]
        if extra > 0 and len(taken) + 1 >= self.many * extra:
            self._rename(new, merged)
            for c in [new, *taken]:
                for _, _, message in c.learned[:1]:
                    self._learn(new.cid, merged, message)
            self._take(new, taken)

    def _rename(self, cluster: Cluster, template: str) -> None:
        self._unindex(cluster)
        cluster.template = template
        self._index(cluster)

    def join(self, message: str, agreed: dict[tuple[str, str], bool] | None = None) -> bool:
        """Whether the message goes to the nearest cluster, by cover or by the provider's word."""
        score, near = self.nearest(message)
        if near is None or score <= self.threshold:
            return False
        merged, _ = merge_templates(message, near.template)
        if not any(ch not in "<>* " for ch in merged):
            return False
        if not covers(message, near.template):
            key = (message, near.template)
            if not (agreed[key] if agreed and key in agreed else self._agreements([key])[key]):
                return False
        if self.generalise:
            self._rename(near, merged)
        self._learn(near.cid, merged, message)
        self._absorb(near)
        return True

    def _agreements(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], bool]:
        """The provider's word on (message, template) pairs, asked for at once."""
        prompt = lambda m, t: merge_text(m, t, self.shown.get(m, [])) if self.provider.prompted else None
        self.asked_same += len(pairs)
        answers = ask_all(self.provider.same, [(m, t, prompt(m, t)) for m, t in pairs])
        return {pair: bool(answer) for pair, answer in zip(pairs, answers, strict=True)}

    # -- schedules ----------------------------------------------------------------

    def settle(self, spark, messages: list[str]) -> None:
        """Give every message a cluster, but those that resemble one whose template is asked for: they wait."""
        open_ = [m for m in messages if self.find(m) is None]
        if self.provider.prompted:
            self.retrieve(spark, open_)
        near = [(m, *self.nearest(m)) for m in open_]
        agreed = self._agreements([(m, c.template) for m, score, c in near if score > self.threshold and not covers(m, c.template)])
        asked, in_flight = [], TokenIndex()
        for message in open_:
            if self.find(message) is not None or self.join(message, agreed):
                continue
            words = self.lettered(message)
            if in_flight.overlap(words) <= self.threshold:
                in_flight.put(len(asked), words)
                asked.append(message)
        for message, template in self.propose(spark, asked):
            if self.find(message) is None and not self.join(message):
                self.accept(message, template)

    def retrieve(self, spark, messages: list[str]) -> None:
        """Note the nearest examples of each message."""
        self.shown = {m: [] for m in messages}
        if not self.examples or not messages:
            return
        known = spark.createDataFrame([(i, e["content"], e["template"]) for i, e in enumerate(self.examples)], "id long, content string, template string")
        fitted = wild_align_udf("template", "content")
        index = example_index(known.select("id", fitted.alias("a")).select("id", "a.template", "a.contents"))
        asked = spark.createDataFrame(list(enumerate(messages)), "id long, text string")
        for r in example_knn(asked, index, self.k).orderBy("id", F.desc("rank")).collect():
            self.shown[messages[r.id]].append(self.examples[r.cand_id])

    def propose(self, spark, messages: list[str]) -> list[tuple[str, str]]:
        """(message, template): the provider's answers, unwrapped, fitted, corrected; digits or heuristics where none serves."""
        if not messages:
            return []
        prompts = [extract_text(m, self.shown[m]) if self.provider.prompted else None for m in messages]
        answers = ask_all(self.provider.template, list(zip(messages, prompts, strict=True)))
        self.asked += len(messages)
        rows = spark.createDataFrame(list(enumerate(zip(messages, answers, strict=True))), "i int, r struct<message:string,answer:string>")
        message, answer = F.col("r.message"), F.col("r.answer")
        tagged = F.when(F.contains(answer, F.lit("<START>")) | F.contains(answer, F.lit("<END>")), unwrap_response(answer)).otherwise(answer)
        got = rows.select("i", message.alias("message"), F.coalesce(tagged, digit_fallback(message)).alias("answer")).orderBy("i").collect()
        fitted = [(n, r.message, wild_align(r.answer, r.message)[0]) for n, r in enumerate(got)]
        frame = spark.createDataFrame(fitted, "i int, message string, fitted string")
        corrected = merge_wilds(correct_template(F.col("fitted")))
        chosen = F.when(has_constant(corrected), corrected).otherwise(heuristic_template(F.col("message")))
        return [(r.message, r.t) for r in frame.select("i", "message", chosen.alias("t")).orderBy("i").collect()]

    def learn(self, spark, messages: list[str]) -> list[int]:
        """The cluster of each message, taken one after another. For small data."""
        for message in messages:
            self.settle(spark, [message])
        return [self.find(m) for m in messages]

    def mine(self, lines: DataFrame, line: str = "LineId", content: str = "Content") -> DataFrame:
        """``lines`` with cid and EventTemplate; single-token messages take their heuristic template and no cid.

        Null Content counts as an empty message, which is a single token. Every round settles
        its first leader at least.
        """
        spark = lines.sparkSession
        lines = lines.withColumn("_message", normalize_ws(F.coalesce(F.col(content), F.lit(""))))
        several = lines.where(~is_single(F.col("_message")))
        distinct = several.groupBy("_message").agg(F.min(line).alias("_first")).withColumn("_form", mask_common(F.col("_message")))
        distinct = staged(distinct, "messages")
        open_, batch = distinct, None
        while True:
            rest = staged(self._unmatched(open_), "open")
            if open_ is not distinct:
                discard(open_)
            open_ = rest
            leaders = open_.groupBy("_form").agg(F.min_by("_message", F.struct("_first", "_message")).alias("m"), F.min("_first").alias("f"))
            before, batch = batch, [r.m for r in leaders.orderBy("f", "_form").limit(LEADERS).collect()]
            if not batch:
                break
            if batch == before:
                raise RuntimeError(f"no template was learned for {batch[0]!r}")
            self.settle(spark, batch)
            self.rounds += 1
        discard(open_)
        known = self._directed(trie_match(distinct.select("_message"), self.trie, "_message", "_found"))
        final = spark.createDataFrame([(c.cid, self.root(c.cid), self.clusters[self.root(c.cid)].template) for c in self.clusters] or [(-1, -1, "")], "_cid long, cid long, EventTemplate string")
        known = known.join(final, "_cid", "left").select("_message", "cid", "EventTemplate")
        found = several.join(known, "_message", "left")
        single = lines.where(is_single(F.col("_message"))).select("*", F.lit(None).cast("long").alias("cid"), heuristic_template(F.col("_message")).alias("EventTemplate"))
        both = found.select(*single.columns).unionAll(single)
        self.observed = Observation()
        counts = F.count("*").alias("lines"), F.count_if(is_single(F.col("_message"))).alias("single"), F.count_if(F.col("EventTemplate").isNull()).alias("unmatched")
        return both.observe(self.observed, *counts).drop("_message")

    def _directed(self, matched: DataFrame) -> DataFrame:
        """``matched`` with ``_cid``: what is known of the message itself, or else what the trie found."""
        if not self.direct:
            return matched.withColumnRenamed("_found", "_cid")
        direct = matched.sparkSession.createDataFrame(list(self.direct.items()), "_message string, _direct long")
        return matched.join(direct, "_message", "left").withColumn("_cid", F.coalesce("_direct", "_found")).drop("_direct", "_found")

    def _unmatched(self, distinct: DataFrame) -> DataFrame:
        return self._directed(trie_match(distinct, self.trie, "_message", "_found")).where("_cid is null").select(*distinct.columns)

    # -- state ----------------------------------------------------------------------

    def state(self) -> list[tuple]:
        """One row a cluster: cid, template, into, learned."""
        return [(c.cid, c.template, c.into, c.learned) for c in self.clusters]

    def restore(self, rows: list[tuple]) -> None:
        """The miner as it was when ``state`` gave these rows."""
        self.clusters = [Cluster(cid, template, into, [tuple(x) for x in learned]) for cid, template, into, learned in sorted(rows, key=lambda r: r[0])]
        self.trie, self.direct, self.tokens, self.shapes, self.by_template = Trie(), {}, TokenIndex(), CoverIndex(), {}
        learned = sorted((at, c.cid, template, message) for c in self.clusters for at, template, message in c.learned)
        self.entries = len(learned)
        for _, cid, template, message in learned:
            self._enter(cid, template, message)
        for c in self.live():
            self._index(c)


def outputs(mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The structured lines with EventId (dense, by first line), and EventId, EventTemplate, Occurrences."""
    events = mined.groupBy("EventTemplate").agg(F.min("LineId").alias("first"), F.count("*").alias("Occurrences"))
    events = events.withColumn("EventId", F.row_number().over(Window.orderBy("first")) - 1)  # one row a template
    structured = mined.drop("cid").join(events.select("EventTemplate", "EventId"), "EventTemplate")
    return structured, events.select("EventId", "EventTemplate", "Occurrences")
