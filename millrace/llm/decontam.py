"""Benchmark decontamination by canonical templates.

Texts become template tokens: lower-case words, and typed slots for numbers (``<n>``),
names (``<a>``: runs of capitalised words inside a sentence) and units (``<u>``: a
unit after a number). Windows of ``WINDOW`` template tokens are hashed on both sides
and joined, so a question with other numbers or names still meets its item. Shorter
items of at least ``SHORTEST`` tokens are one window of their own length. Windows with
fewer constant tokens than half, rounded up, say little by their template: they count
where every slot has the item's value, or on a consistent diagonal of ``RUN`` windows.
Those of slots alone meet by their values only.

A filter of fixed size (``BITS`` bits, two per window) over the benchmark's windows is
sent to the tasks; only document windows that pass are shuffled. It decides nothing:
the join on hash and template text does.

Matched windows are put on diagonals (document place minus item place). A diagonal is
consistent if each slot value of the item always meets the same value in the document;
only such diagonals count. A document is contaminated by an item if the matched
windows make up ``COVERAGE`` of the item's, of all or of those with constants enough,
or ``RUN`` of them lie on one diagonal.

A name is only told by its capitals, so each item is also looked for with its names as
words: a copy in small letters is found, one with other names in small letters is not.

Defined cases: null and empty texts have no windows; texts of any length count whole; an empty table on
either side gives no rows; rows with equal doc_id and text
are one row of the result; a null doc_id is kept as null; items with equal text count
once, under their least item_id; items without item_id or with fewer than ``SHORTEST``
tokens match nothing (``unmatchable`` lists those); other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import discard, map_texts, staged

WINDOW, SHORTEST = 8, 4
COVERAGE, RUN = 0.5, 13
BITS = 1 << 24

NUMBER, NAME, UNIT = "<n>", "<a>", "<u>"
# Words for numbers and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l"
    " liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months"
    " year years percent dollar dollars cent cents euro euros mph kmh km/h degrees".split()
)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[%$€£°]|[.!?\n]")
_STOP = frozenset(".!?\n")


def template(text: str | None, names: bool = True) -> tuple[list[str], list[str | None]]:
    """The template tokens of a text and, for each, the slot's value or None; without ``names`` these are words like others."""
    tokens: list[str] = []
    values: list[str | None] = []
    opening = True
    for raw in _TOKEN.findall(text or ""):
        if raw in _STOP:
            opening = True
            continue
        word = raw.lower()
        if raw[0].isdigit() or word in NUMBER_WORDS:
            token, value = NUMBER, word
        elif word in UNITS and tokens and tokens[-1] == NUMBER:
            token, value = UNIT, word
        elif names and not opening and raw[0].isupper() and not raw.isupper():
            token, value = NAME, word
            if tokens and tokens[-1] == NAME:
                values[-1] += " " + word
                continue
        elif not raw[0].isalpha():
            continue
        else:
            token, value = word, None
        opening = False
        tokens.append(token)
        values.append(value)
    return tokens, values


class Hasher:
    """Window hashes: token hashes, remembered for up to ``MOST`` tokens, rolled by powers of an odd number."""

    MOST = 300_000
    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def tokens(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        except KeyError:
            new = set(tokens).difference(known)
        if len(known) > self.MOST:
            known.clear()
            new = set(tokens)
        for t in new:
            known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(self.BASE) + hashes[k : k + len(out)]
        return out


def constant_enough(values: list[str | None], at: int, size: int) -> bool:
    return 2 * values[at : at + size].count(None) >= size


def window_key(tokens: list[str], values: list[str | None], at: int, size: int, shape: int) -> tuple[int, str]:
    """Hash and pattern that a window is joined by: of its template, or of its values where it has slots alone."""
    pattern, slots = " ".join(tokens[at : at + size]), values[at : at + size]
    if None in slots:
        return shape, pattern
    pattern += "\n" + "\n".join(slots)
    key = xxhash.xxh64_intdigest(pattern.encode("utf-8", "surrogatepass"))
    return key - (1 << 64) if key >> 63 else key, pattern


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """hash, size, pattern, item_id, form, at, n, n_firm, firm, slots and shape of every place of the benchmark's windows.

    Items with names have two forms: with slots for them (0), and with the names as words (1), as they
    look in a text without capitals. ``firm`` windows have constants enough; ``n`` and ``n_firm`` are the form's distinct
    windows, all and firm. ``shape`` is the hash of the template.
    """

    def make():
        hasher = Hasher()

        def work(rows):
            out = []
            for item_id, text in rows:
                forms = [template(text), template(text, names=False)]
                for form, (tokens, values) in enumerate(forms):
                    if len(tokens) < SHORTEST or (form and tokens == forms[0][0]):
                        continue
                    size, found = min(window, len(tokens)), []
                    for at, shape in enumerate(hasher.windows(hasher.tokens(tokens), size).view(np.int64).tolist()):
                        h, pattern = window_key(tokens, values, at, size, shape)
                        found.append((h, pattern, at, constant_enough(values, at, size), shape))
                    n, n_firm = len({h for h, *_ in found}), len({h for h, _, _, firm, _ in found if firm})
                    for h, pattern, at, firm, shape in found:
                        slots = [v for v in values[at : at + size] if v is not None]
                        out.append((h, size, pattern, item_id, form, at, n, n_firm, firm, slots, shape))
            return out

        return work

    unique = items.where("item_id is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    schema = "hash long, size int, pattern string, item_id long, form int, at int, n int, n_firm int, firm boolean, slots array<string>, shape long"
    return map_texts(unique, make, schema, ("item_id", "text"))


def unmatchable(items: DataFrame) -> DataFrame:
    """item_id of the items that can match nothing: those of fewer than SHORTEST tokens."""

    def make():
        return lambda rows: [(i,) for i, text in rows if len(template(text, names=False)[0]) < SHORTEST]

    return map_texts(items, make, "item_id long", ("item_id", "text"))


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return hashes & np.uint64(BITS - 1), hashes >> np.uint64(30) & np.uint64(BITS - 1)


def filter_bits(windows: DataFrame) -> np.ndarray:
    """The filter's bits as bytes; at most BITS / 64 rows come to the driver, whatever the benchmark's size."""
    bit = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned("hash", 30).bitwiseAND(F.lit(BITS - 1))))
    masks = (
        windows.select(bit.alias("bit"))
        .groupBy((F.col("bit") / 64).cast("long").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    )
    words = np.zeros(BITS // 64, dtype=np.int64)
    for r in masks.collect():
        words[r.word] = r.mask
    return words.view(np.uint8)


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, key (a hash of the text), hash, pattern, place and slots of every place of a document window that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        hasher, table = Hasher(), shared.value

        def known(h: int) -> bool:
            return all(table[place >> 3] >> (place & 7) & 1 for place in (h & (BITS - 1), h >> 30 & (BITS - 1)))

        def passes(places: np.ndarray) -> np.ndarray:
            return table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1 == 1

        def work(rows):
            out = []
            for doc_id, key, text in rows:
                tokens, values = template(text)
                hashes = hasher.tokens(tokens)
                for size in sizes:
                    windows = hasher.windows(hashes, size)
                    if not len(windows):
                        continue
                    one, two = _places(windows)
                    hits = np.flatnonzero(passes(one))
                    hits = hits[passes(two[hits])]
                    for at, shape in zip(hits.tolist(), windows[hits].view(np.int64).tolist(), strict=True):
                        h, pattern = window_key(tokens, values, at, size, shape)
                        if h == shape or known(h):
                            slots = [v for v in values[at : at + size] if v is not None]
                            out.append((doc_id, key, h, pattern, at, slots))
            return out

        return work

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return map_texts(keyed, make, "doc_id long, key long, hash long, pattern string, place int, slots array<string>", ("doc_id", "key", "text"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, item_id, n_matched, coverage and exact of each contaminated document and item.

    ``exact``: diagonals on which no slot differs suffice by themselves.
    """
    wanted = staged(item_windows(items, window), "decontam-items")
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())  # at most WINDOW values
    marks = wanted.select(F.explode(F.array("hash", "shape")).alias("hash")).distinct()
    seen = document_windows(docs, filter_bits(marks), sizes).withColumnRenamed("slots", "values")
    pairs = seen.distinct().join(wanted, ["hash", "pattern"]).select(
        "doc_id", "key", "item_id", "form", "n", "n_firm", "firm", "hash", (F.col("place") - F.col("at")).alias("diagonal"),
        (F.col("slots") == F.col("values")).alias("equal"), F.arrays_zip("slots", "values").alias("slots"),
    )
    pairs = staged(pairs, "decontam-pairs")
    discard(wanted)
    line = ["doc_id", "key", "item_id", "form", "diagonal"]
    filled = pairs.select(*line, "firm", F.explode("slots").alias("s")).select(*line, "firm", "s.slots", "s.values")
    of_firm = F.when(F.col("firm"), F.col("values"))
    per_value = filled.groupBy(*line, "slots").agg(
        F.min("values").alias("a"), F.max("values").alias("b"), F.min(of_firm).alias("firm_a"), F.max(of_firm).alias("firm_b")
    )
    per_line = per_value.groupBy(*line).agg(
        F.min(F.col("a") == F.col("b")).alias("all_consistent"),
        F.min((F.col("a") == F.col("slots")) & (F.col("a") == F.col("b"))).alias("all_same"),
        F.min(F.col("firm_a") == F.col("firm_b")).alias("consistent"),
        F.min((F.col("firm_a") == F.col("slots")) & (F.col("firm_a") == F.col("firm_b"))).alias("same"),
    )
    lines = pairs.groupBy(*line).agg(
        F.count("*").alias("on_line"), F.count_if("firm").alias("firm_on_line"), F.first("n").alias("n"), F.first("n_firm").alias("n_firm"),
        F.collect_set(F.when(F.col("firm"), F.col("hash"))).alias("firm_hashes"),
        F.collect_set(F.when(~F.col("firm"), F.col("hash"))).alias("loose"),
        F.collect_set(F.when(~F.col("firm") & F.col("equal"), F.col("hash"))).alias("loose_equal"),
    )
    # Null document ids must meet themselves.
    facts = ["all_consistent", "all_same", "consistent", "same"]
    per_line = per_line.select(*(F.col(c).alias(f"_{c}") for c in line), *facts)
    on = F.lit(True)
    for c in line:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    lines = lines.join(per_line, on, "left").withColumns({c: F.coalesce(c, F.lit(True)) for c in facts})
    # What counts on a line: firm windows if they are consistent, equal ones, and all of a long consistent line.
    long = F.col("all_consistent") & (F.col("on_line") >= RUN)
    lines = lines.withColumns({
        "of_firm": F.when(F.col("consistent"), F.col("firm_hashes")),
        "of_loose": F.when(long, F.col("loose")).otherwise(F.col("loose_equal")),
        "run": F.greatest(F.when(F.col("consistent"), F.col("firm_on_line")), F.when(F.col("all_consistent"), F.col("on_line")), F.lit(0)),
        "same_run": F.greatest(F.when(F.col("same"), F.col("firm_on_line")), F.when(F.col("all_same"), F.col("on_line")), F.lit(0)),
    })
    windows = lambda hashes: F.size(F.array_distinct(F.flatten(F.collect_list(hashes))))
    found = lines.groupBy("doc_id", "key", "item_id", "form").agg(
        windows(F.col("of_firm")).alias("firm"),
        windows(F.col("of_loose")).alias("loose"),
        windows(F.when(F.col("same"), F.col("firm_hashes"))).alias("firm_same"),
        windows(F.col("loose_equal")).alias("loose_same"),
        F.max("run").alias("longest"),
        F.max("same_run").alias("longest_same"),
        F.first("n").alias("n"),
        F.first("n_firm").alias("n_firm"),
    )

    def share(firm: str, loose: str) -> Column:
        return F.greatest((F.col(firm) + F.col(loose)) / F.col("n"), F.try_divide(F.col(firm), F.col("n_firm")))

    return (
        found.withColumn("n_matched", F.col("firm") + F.col("loose"))
        .withColumn("coverage", share("firm", "loose"))
        .where((F.col("coverage") >= COVERAGE) | (F.col("longest") >= RUN))
        .withColumn("exact", (share("firm_same", "loose_same") >= COVERAGE) | (F.col("longest_same") >= RUN))
        .groupBy("doc_id", "key", "item_id")
        .agg(F.max(F.struct("coverage", "n_matched")).alias("best"), F.max("exact").alias("exact"))
        .select("doc_id", "key", "item_id", "best.n_matched", "best.coverage", "exact")
    )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, coverage and exact; clean documents have no row."""
    return matches(docs, items).drop("key")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay."""
    bad = staged(matches(docs, items).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "decontam-docs")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(bad, on, "left_anti")
