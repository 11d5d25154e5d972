"""SimHash near-duplicate groups: BK-trees over shards of fingerprints.

A fingerprint has 64 bits; two link at ``RADIUS`` = 2 or fewer differing bits.

* Shards come from the pigeonhole principle: with four 16-bit blocks at most two
  of which can hold a difference, two blocks are equal, so a pair meets in one of
  six shards keyed by two whole blocks. A shard above ``SPLIT`` fingerprints is
  dealt again by two of the four bytes in its other 32 bits; what then shares a
  shard agrees on 48 bits, so no shard exceeds 65,536 distinct fingerprints.
* In a shard, fingerprints go one after another into a BK-tree (children keyed by
  their integer Hamming distance to the parent); each first searches the tree,
  along edges within the radius only, and is united with what it finds. The shard
  emits a spanning star of each group, never its pairs.
* The trees are not broadcast: all trees together grow with the data, so a tree is
  built in the task to which its shard is shuffled, where all its probes are.
* Groups that meet in several shards are joined by alternating large-star and
  small-star steps over DataFrames, each step stored.

``keep_one`` goes further than these groups: documents whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more are near-duplicates, too. Their SimHashes
differ in 15 % of their bits, beyond what trees can tell from chance, so ``setjoin``
finds and verifies those links exactly, and they join the trees' groups.

Defined cases: a null or blank text has fingerprint zero, and zero links like any
other; repeated rows stay repeated and share a group; a null doc_id belongs to its
group but never names it; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import setjoin
from millrace.llm.base import WordHashes, discard, map_texts, signed, staged

RADIUS = 2
SEED = 42
SHINGLE = 3
#: Fingerprints of a shard beyond which it is dealt again by 16 more bits.
SPLIT = 512
#: Shingles whose bits are counted at once, so that a long text needs little memory.
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit integer."""
    return print_of(setjoin.words_of(text), shingle)


def print_of(words: list[bytes], shingle: int = SHINGLE) -> int:
    """``fingerprint`` of a text's words."""
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digests = list(map(partial(xxhash.xxh64_digest, seed=SEED), shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), BLOCK):
        part = np.frombuffer(b"".join(digests[at : at + BLOCK]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long), one row per row of ``docs``."""

    def make():
        return lambda rows: [(i, signed(fingerprint(t, shingle))) for i, t in rows]

    return map_texts(docs, make, "doc_id long, fp long")


class BKTree:
    """Distinct integers; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of stored values at ``radius`` or fewer differing bits."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)
        return found

    def insert(self, value: int) -> int:
        """Position of ``value``, which is added if it is new."""
        node, new = 0, len(self.values)
        while self.values and (distance := (self.values[node] ^ value).bit_count()):
            if distance not in self.children[node]:
                self.children[node][distance] = new
                break
            node = self.children[node][distance]
        else:
            if self.values:
                return node
        self.values.append(value)
        self.children.append({})
        return new


def shard_groups(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, least member) of each group of two or more in a shard, the least left out."""
    values = sorted(set(values))
    tree, parent = BKTree(), list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = root(at), root(other)
            parent[max(a, b)] = min(a, b)
        tree.insert(value)
    return [(values[x], values[root(x)]) for x in range(len(values)) if root(x) != x]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[int]]:
    """The fp values of each run of equal (shard, sub) in sorted batches; runs may cross batches."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, sub, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (sub[1:] != sub[:-1])) + 1
        for part, start in zip(np.split(fp, cuts), [0, *cuts.tolist()], strict=True):
            key = (shard[start], sub[start])
            if key != current and held:
                yield held
                held = []
            current = key
            held += part.tolist()
    if held:
        yield held


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int]] = []
    for values in _runs(batches):
        if len(values) > 1:
            rows += shard_groups([v & 0xFFFFFFFFFFFFFFFF for v in values])
        if len(rows) >= 50_000:
            yield _edges(rows)
            rows = []
    if rows:
        yield _edges(rows)


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _field(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def shards(distinct: DataFrame) -> DataFrame:
    """(shard, sub, fp): every shard that a pair of linked fingerprints can meet in."""
    by_blocks = F.array(
        *(
            F.shiftleft(F.lit(n).cast("long"), 32)
            .bitwiseOR(F.shiftleft(_field(16 * i, 16), 16))
            .bitwiseOR(_field(16 * j, 16))
            for n, (i, j) in enumerate(combinations(range(4), 2))
        )
    )
    keyed = distinct.select("fp", F.explode(by_blocks).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    keyed = keyed.join(sizes, "shard")
    # The two blocks that shard number n does not fix, as four bytes; two of them are equal in a linked pair.
    other = F.element_at(
        F.array(
            *(
                F.array(*(_field(16 * b + 8 * half, 8) for b in range(4) if b not in pair for half in range(2)))
                for pair in combinations(range(4), 2)
            )
        ),
        (F.shiftrightunsigned("shard", 32) + 1).cast("int"),
    )
    again = F.array(
        *(
            F.shiftleft(F.lit(n + 1).cast("long"), 16)
            .bitwiseOR(F.shiftleft(F.get("rest", F.lit(i)), 8))
            .bitwiseOR(F.get("rest", F.lit(j)))
            for n, (i, j) in enumerate(combinations(range(4), 2))
        )
    )
    whole = F.array(F.lit(0).cast("long"))
    return keyed.withColumn("rest", other).select(
        "shard", F.explode(F.when(F.col("size") > SPLIT, again).otherwise(whole)).alias("sub"), "fp"
    )


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that span every group of linked fingerprints, b below a as unsigned numbers."""
    dealt = shards(distinct).repartition("shard", "sub").sortWithinPartitions("shard", "sub")
    return dealt.mapInArrow(_search, "a long, b long").distinct()


def loose(edges: DataFrame) -> bool:
    """Whether some edge (a, b) is not one of a star: its a has other edges, or is another edge's b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("n"), F.min("e.out").alias("least"))
    return bool(nodes.agg(F.max((F.col("n") > 1) | (F.col("n") == 1) & (F.col("least") == 0))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b); root is the least node, each root included.

    Stars whose centre is their least node are what the steps lead to and leave as it is, so no step is spent
    on finding that nothing changes. Least neighbours are stored before they are joined, so that a node of many
    neighbours can be split by adaptive planning.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while loose(now):
        # Large star: each node hands its least neighbour to its greater neighbours.
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours hang from the least of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(hung.union(lowest.select("a", "m")).distinct(), "star")
        discard(now, least)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )


def grouped(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for a stored frame of (doc_id, fp).

    What copies share is stored before it is joined with the rows, so that adaptive
    planning can split a fingerprint that many rows have.
    """
    groups = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-fp")
    linked = components(links(groups.select("fp")))
    member = linked.join(groups, linked.node == groups.fp).select("node", "root", "first")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    named = member.join(least, "root").select(F.col("node").alias("fp"), "least")
    shared = (
        groups.join(named, "fp", "left")
        .where("n > 1 or least is not null")
        .select("fp", F.coalesce("least", "first").alias("of_group"))
    )
    shared = staged(shared, "simhash-shared")
    discard(groups)
    return prints.join(shared, "fp", "left").select(
        "doc_id", "fp", F.coalesce("of_group", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    prints = staged(fingerprints(docs, shingle), "simhash-doc")
    return grouped(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- one document of each group -------------------------------------------------------


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp, and of its set of five-word shingles the name (node), parity sketch and prefix by hash (least)."""

    def make():
        hashes = WordHashes()

        def work(rows):
            out = []
            for doc_id, key, text in rows:
                words = setjoin.words_of(text)
                shingles = setjoin.shingle_set(words, hashes)
                least = shingles[: setjoin.prefix_length(len(shingles))].view(np.int64)
                out.append((doc_id, key, signed(print_of(words)), setjoin.name_of(shingles), setjoin.parity(shingles), least))
            return out

        return work

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return map_texts(keyed, make, "doc_id long, key long, fp long, node long, parity array<long>, least array<long>", ("doc_id", "key", "text"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key and group of each row: rows whose fingerprints link or whose texts are similar have one group.

    Nodes (sets of shingles) of one fingerprint group come together first; ``setjoin`` adds
    the links of similarity.
    """
    prints = staged(sketches(docs), "simhash-sketch")
    named = components(links(prints.select("fp").distinct())).toDF("fp", "class")
    nodes = prints.select("fp", "node").distinct().join(named, "fp", "left").select("node", F.coalesce("class", "fp").alias("class"))
    nodes = staged(nodes.distinct(), "simhash-nodes")
    least = nodes.groupBy("class").agg(F.min("node").alias("b"))
    roots = staged(components(nodes.join(least, "class").select(F.col("node").alias("a"), "b")), "simhash-roots")
    worded = prints.where(F.col("node") != setjoin.EMPTY)
    one = F.min(F.struct("key", "parity")).alias("k")
    keys = staged(worded.groupBy("node").agg(one).select("node", "k.*"), "simhash-keys")
    roots = setjoin.similar_components(docs, keys, worded.select("least"), roots, components)
    found = prints.select("doc_id", "key", "node").join(roots, "node", "left")
    found = staged(found.select("doc_id", "key", F.coalesce("root", "node").alias("group")), "simhash-groups")
    discard(prints, nodes, keys, roots)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar documents: that of the least doc_id, any before none.

    Rows that share a doc_id, and rows without one, are told apart by a hash of the text;
    of those that agree in both, the one with the least row hash stays.
    """
    groups = similar_groups(docs)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    kept = staged(first.select("f.doc_id", "f.key"), "simhash-kept")
    odd = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    odd = staged(odd, "simhash-odd")
    discard(groups)
    plain = kept.join(odd, "doc_id", "left_anti").select("doc_id")
    plain = docs.join(plain.where("doc_id is not null"), "doc_id", "left_semi").select(*docs.columns)
    if odd.isEmpty():
        return plain
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    rest = docs.withColumn("_text", F.xxhash64("text")).join(odd.toDF("_id"), same, "left_semi")
    rest = rest.join(kept.toDF("_id", "_key"), same & (F.col("_text") == F.col("_key")), "left_semi")
    one = rest.groupBy("doc_id", "_text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return plain.union(one.select("row.*"))
