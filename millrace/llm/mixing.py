"""Mixing sources to target weights: hierarchical budgets over domain, language, source.

Native DataFrame operations only. Weights are integers. The token budget flows down
the tree: at each node it is split among the children by weight, where a child can
take no more than its subtree holds (tokens times ``max_epochs``). What a child
cannot take is shared among its siblings, again by weight, until all are full; so a
shortage reaches other branches only if a whole subtree is short. The split has a
closed form: with the children in rising order of capacity over weight, the full
ones are a prefix.

A leaf that gets A of its T tokens takes A div T whole epochs, and of the next epoch
the longest prefix of at most the remaining tokens. An epoch orders the leaf's
documents by md5 of seed, epoch and doc_id. The prefix's last document is found in
two steps, so that no leaf is sorted in one task: token sums over ranges of the hash,
then a ranking inside the one range in which the budget ends.

Tokens are maximal runs of characters other than space, tab and line feed.

Defined cases: a null language or source is the node ``unknown``; a null text has no
tokens; rows of the same leaf with equal doc_id are taken together or not at all, so
repeated rows stay together; what has a weight of 0 takes nothing, whatever others cannot take
(a weight is never below 0); a null doc_id orders like an empty one; texts of any length count whole; documents without tokens come with the prefix that
reaches them; nothing is selected from an empty table or for a budget of zero; other
columns are ignored, or kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import staged

LEAF = ["domain", "lang", "source"]
#: Hashes are the first 15 hexadecimal digits.
HASHES = 1 << 60
#: Documents that a range of hashes holds on average.
RANGE = 10_000


@dataclass(frozen=True)
class Plan:
    """Integer weights by name (others: ``default``), and how much to take.

    The budget is ``share_percent`` of all tokens of the input.
    """

    domains: dict[str, int] = field(default_factory=lambda: {"web": 40, "forum": 20, "reference": 25, "news": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 15, "es": 15})
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 5
    share_percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source, by the number in its name."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    n = F.when(F.length(number).between(1, 9), number.cast("int"))
    return (
        F.when(n < 5, "web").when(n < 10, "forum").when(n < 15, "reference").when(n >= 15, "news").otherwise("other")
    )


def weight(name: Column, given: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in sorted(given.items()):
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def leaves_of(docs: DataFrame) -> list[Column]:
    source = F.coalesce("source", F.lit("unknown"))
    return [domain_of(source).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), source.alias("source")]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf and n_tokens of each row."""
    tokens = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n]+")).cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", *leaves_of(docs), tokens.alias("n_tokens"))


def split(children: DataFrame, parent: list[str], name: str, weights: Column) -> DataFrame:
    """``children`` (parent, name, capacity, budget of the parent) with ``alloc``, each child's part of the budget."""
    rows = children.withColumn("w", weights)
    # A child of weight 0 is full with nothing, and comes first.
    rows = rows.withColumn("capacity", F.when(F.col("w") > 0, F.col("capacity")).otherwise(F.lit(0)))
    order = [F.try_divide("capacity", "w"), F.col(name)]
    key = parent or [F.lit(0)]
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    big = "decimal(38,0)"
    rows = (
        rows.withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("w_rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn(
            "full",
            F.col("capacity").cast(big) * F.col("w_rest").cast(big)
            <= (F.col("budget") - F.col("c_before")).cast(big) * F.col("w").cast(big),
        )
        .withColumn("c_full", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
    )
    part = F.expr(f"cast(((budget - c_full) * cast(w as {big})) div w_open as bigint)")
    return rows.withColumn("alloc", F.when(F.col("full"), F.col("capacity")).otherwise(part)).select(
        *parent, name, "capacity", "alloc"
    )


def allocate(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Leaves (domain, lang, source, n_docs, tokens) with ``alloc``, their tokens to take."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * plan.max_epochs)
    total = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0) * {plan.share_percent}) div 100").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).crossJoin(total)  # one row
    domains = split(domains, [], "domain", weight(F.col("domain"), plan.domains, plan.default))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    langs = langs.join(domains.select("domain", F.col("alloc").alias("budget")), "domain")
    langs = split(langs, ["domain"], "lang", weight(F.col("lang"), plan.languages, plan.default))
    own = leaves.join(langs.select("domain", "lang", F.col("alloc").alias("budget")), ["domain", "lang"])
    own = split(own, ["domain", "lang"], "source", weight(F.col("source"), plan.sources, plan.default))
    return leaves.drop("capacity").join(own.select(*LEAF, "alloc"), LEAF)


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch, below HASHES."""
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def cuts(base: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf: tokens to take, whole ``epochs``, and (cut_hash, cut_id), the last key of the next epoch's prefix."""
    leaves = base.groupBy(*LEAF).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    leaves = allocate(leaves, plan)
    width = F.floor(F.lit(HASHES) / F.ceil(F.col("n_docs") / RANGE)).cast("long") + 1
    leaves = leaves.select(
        *LEAF,
        "alloc",
        F.expr("if(tokens > 0, alloc div tokens, 0)").alias("epochs"),
        F.expr("if(tokens > 0, alloc % tokens, 0)").alias("rest"),
        width.alias("width"),
    )
    leaves = staged(leaves, "mix-leaves")  # one row a leaf; also gives the optimiser its size
    partial = base.join(leaves.where("rest > 0"), LEAF).withColumn(
        "h", order_hash(plan.seed, F.col("epochs"), F.col("doc_id"))
    )
    ranged = partial.withColumn("bucket", F.expr("h div width"))
    sums = ranged.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        sums.withColumn("to", F.sum("t").over(upto))
        .where("to > rest")
        .groupBy(*LEAF)
        .agg(F.min_by(F.struct("bucket", (F.col("to") - F.col("t")).alias("before")), "bucket").alias("e"))
        .select(*LEAF, F.col("e.bucket").alias("bucket"), F.col("e.before").alias("before"))
    )
    edge = staged(edge, "mix-edges")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    last = (
        ranged.join(edge, [*LEAF, "bucket"])
        .withColumn("id", key)
        .groupBy(*LEAF, "bucket", "before", "rest", "h", "id")
        .agg(F.sum("n_tokens").alias("t"))
        .withColumn("to", F.col("before") + F.sum("t").over(Window.partitionBy(*LEAF).orderBy("h", "id")))
        .where("to <= rest")
        .groupBy(*LEAF)
        .agg(F.max(F.struct("h", "id")).alias("cut"))
    )
    return (
        leaves.join(edge, LEAF, "left")
        .join(last, LEAF, "left")
        .select(
            *LEAF,
            "alloc",
            "epochs",
            F.coalesce("cut.h", F.expr("bucket * width - 1"), F.lit(-1)).alias("cut_hash"),
            F.coalesce("cut.id", F.lit((1 << 63) - 1)).alias("cut_id"),
        )
    )


def _taken(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows joined with their leaf's cut, repeated once an epoch (column ``epoch``)."""
    h = order_hash(plan.seed, F.col("epochs"), F.col("doc_id"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    inside = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (key <= F.col("cut_id")))
    times = (F.col("epochs") + inside.cast("long")).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))
    )


def select(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens of everything that is taken."""
    plan = plan or Plan()
    base = staged(counted(docs), "mix-docs")
    found = _taken(base.join(staged(cuts(base, plan), "mix-cuts"), LEAF), plan)
    return found.select("doc_id", *LEAF, "epoch", "n_tokens")


def mixed(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The rows of ``docs`` that are taken, once an epoch, with their columns as they are."""
    plan = plan or Plan()
    base = staged(counted(docs), "mix-docs")
    at = staged(cuts(base, plan).select(*(F.col(c).alias(f"_{c}") for c in LEAF), "epochs", "cut_hash", "cut_id"), "mix-cuts")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", *(c.alias(f"_{n}") for c, n in zip(leaves_of(docs), LEAF, strict=True)))
    found = _taken(rows.join(at, [f"_{c}" for c in LEAF]), plan)
    return found.select("_row.*")
