"""Exact links between texts whose sets of word shingles are similar.

Two texts link if the Jaccard similarity of their sets of five-word shingles is
``SHARE`` or more. No link is lost, and no crowd of copies is written out in pairs:

* Texts with the same set are one node, named by a hash of the set.
* Prefix filter. With all shingles in one order, two linked sets have a common shingle
  among the first ``prefix_length`` of each; only those are shuffled. The order puts
  shingles that are frequent in prefixes by hash last (known from marks of fixed size),
  the others first, and then goes by hash. Any order gives the same links; this one keeps
  passages that many texts share out of the prefixes.
* A run is what has one prefix shingle. A pair in a run is possible if the sizes, what
  is left behind the common shingle, and the parity sketches allow the similarity. The
  Hamming distance of sketches is never above the number of shingles that only one of both has.
* Rounds. In every run each node takes the first possible nodes of other components as
  partners, unless they were compared before: one in the first round, then up to ``MORE``
  times as many each round. Links join components. Rounds end when no run has a possible
  pair of different components that was not compared.
* Partners are compared shingle by shingle.

A node meets others as long as it fails, so every linked pair ends in one component, while
a crowd of n copies, joined in the first round, costs about n comparisons. Shingles are
known by 64-bit hashes.

Defined cases: texts of fewer than five words are one shingle of all their words; texts
without words are no nodes (``EMPTY``); repeated rows, null ids and other columns change
nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import ROWS, WordHashes, discard, marked, signed, staged, values

SHINGLE = 5
#: The similarity 0.8 as a fraction.
SHARE, WHOLE = 4, 5
#: Texts beyond which a shingle of the prefixes by hash is put last.
FREQUENT = 32
#: Growth of the number of partners from round to round.
MORE = 32
#: Bits of a parity sketch.
PARITY = 512
#: Nodes that are held against one partner in one task.
CHUNK = 1_000
#: Rows of a run that meet in one task; longer runs are dealt as blocks against blocks.
BLOCK = 20_000
#: The name of the empty set.
EMPTY = 0
#: Texts that a task remembers as sent already.
SEEN = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered, between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The rising hashes of the distinct shingles of a text's words."""
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(0, dtype=np.uint64)
    each = hashes(words)
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * _ODD + each[k : k + len(out)]
    for shift in (np.uint64(32), np.uint64(29)):
        out = (out ^ out >> shift) * _ODD
    return np.unique(out ^ out >> np.uint64(32))


def name_of(shingles: np.ndarray) -> int:
    """The name of a set; not EMPTY unless it is empty."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes()) or 1) if len(shingles) else EMPTY


def prefix_length(n: int) -> int:
    """Shingles of a set of ``n`` of which two linked sets have one in common."""
    return n - -(-SHARE * n // WHOLE) + 1 if n else 0


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit b tells whether an odd number of the set's hashes are b modulo PARITY; as longs."""
    odd = np.bincount((shingles & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def linked(common: int, n: int, m: int) -> bool:
    """Whether sets of ``n`` and ``m`` with ``common`` shared elements are similar enough."""
    return WHOLE * common >= SHARE * (n + m - common)


def frequent_marks(least: DataFrame):
    """Marks of the shingles that more than FREQUENT of the prefixes by hash hold (column ``least``, an array)."""
    each = least.select(F.explode("least").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    return marked(each.where(F.col("n") > FREQUENT), F.col("shingle"))


def prefixes(docs: DataFrame, marks) -> DataFrame:
    """shingle, node and place (set size above, position below 32 bits) of every node's prefix.

    A task sends a node once; equal nodes of other tasks meet in the runs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hashes, seen = shared.value, WordHashes(), set()
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out: list[np.ndarray] = []
            nodes, sizes, counts = [], [], []
            for text in values(part.column(0)):
                shingles = shingle_set(words_of(text), hashes)
                node = name_of(shingles)
                if node == EMPTY or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                late = frequent(shingles)
                out.append(np.concatenate([shingles[~late], shingles[late]])[: prefix_length(len(shingles))])
                nodes.append(node)
                sizes.append(len(shingles) << 32)
                counts.append(len(out[-1]))
            if out:
                place = np.repeat(np.array(sizes), counts) + np.concatenate([np.arange(c) for c in counts])
                columns = np.concatenate(out).view(np.int64), np.repeat(np.array(nodes), counts), place
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "node", "place"])

    return docs.select("text").mapInArrow(run, "shingle long, node long, place long")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows of runs of two or more nodes, from rows sorted by shingle and node; one row is held."""
    names = ["shingle", "node", "place"]
    held, joined = [np.zeros(0, dtype=np.int64)] * 3, False

    def chosen(columns: list[np.ndarray], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        if flags.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[flags]) for c in columns], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        new = np.ones(len(columns[0]), dtype=bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        columns = [c[new] for c in columns]
        same = columns[0][1:] == columns[0][:-1]
        several = np.append(joined, same)  # with the row before
        yield from chosen([c[:-1] for c in columns], several[:-1] | same)
        held, joined = [c[-1:] for c in columns], several[-1]
    yield from chosen(held, np.full(len(held[0]), joined))


def _whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables in which every run of equal (shingle, cell) is whole; one run and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = len(shingle) - int(np.argmax(((shingle != shingle[-1]) | (cell != cell[-1]))[::-1])) if shingle[0] != shingle[-1] or cell[0] != cell[-1] else 0
        if not last and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (shingle[0], cell[0]):
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def partners(run: np.ndarray, node: np.ndarray, place: np.ndarray, root: np.ndarray, sketch: np.ndarray, failed: dict[int, set[int]], most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their partners' rows in runs (rising ids ``run``, nodes rising in a run), at most ``most`` for a row.

    ``sketch``: the parity sketch of each row, as a row of longs. ``failed``: for a node the smaller nodes that it was compared with in vain.
    """
    size, left = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
    count = np.zeros(len(run), dtype=np.int64)
    open_ = np.arange(len(run))
    rows, leads = [open_[:0]], [open_[:0]]
    while len(open_):
        first = np.ones(len(open_), dtype=bool)
        first[1:] = run[open_[1:]] != run[open_[:-1]]
        group = np.cumsum(first) - 1
        lead = open_[first][group]
        # A run in which all that is left is of one component is done.
        apart = root[open_] != root[lead]
        alive = (np.bincount(group, apart) > 0)[group]
        open_, lead, apart, first = open_[alive], lead[alive], apart[alive], first[alive]
        n, m = size[open_], size[lead]
        fits = apart & (WHOLE * np.minimum(n, m) >= SHARE * np.maximum(n, m))
        fits &= (WHOLE + SHARE) * np.minimum(left[open_], left[lead]) >= SHARE * (n + m)
        at = np.flatnonzero(fits)
        differ = (sketch[open_[at]] ^ sketch[lead[at]]).view(np.uint64)
        distance = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        fits[at] = (WHOLE + SHARE) * distance <= (WHOLE - SHARE) * (n[at] + m[at])
        if failed:
            for k in np.flatnonzero(fits):
                if int(node[lead[k]]) in failed.get(int(node[open_[k]]), ()):
                    fits[k] = False
        rows.append(open_[fits])
        leads.append(lead[fits])
        count[open_] += fits
        open_ = open_[(count[open_] < most) & ~first]
    return np.concatenate(rows), np.concatenate(leads)


def _partnered(most: int):
    names = ["shingle", "node", "place", "partner"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs that go on, once, with null partners; and (node, partner) of pairs to compare."""
        for table in _whole_runs(batches):
            shingle, cell, node, place, root, home, dealt = (table.column(k).to_numpy() for k in range(7))
            sketch = table.column(7).combine_chunks().flatten().to_numpy().reshape(-1, PARITY // 64)
            vain = table.column(8)
            tried = np.flatnonzero(vain.is_valid().to_numpy()).tolist()
            failed = {int(node[k]): set(vain[k].as_py()) for k in tried}
            part = np.append(0, np.cumsum((shingle[1:] != shingle[:-1]) | (cell[1:] != cell[:-1])))
            rows, leads = partners(part, node, place, root, sketch, failed, most)
            stays = home & (dealt | np.isin(part, part[rows]))
            if stays.any():
                none = pa.nulls(int(stays.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c[stays]) for c in (shingle, node, place)), none], names=names)
            if len(rows):
                pairs = np.unique(np.stack([node[rows], node[leads]]), axis=1)
                zero = np.zeros(pairs.shape[1], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (zero, pairs[0], zero, pairs[1])], names=names)

    return run


def cells(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of runs with ``cell``, ``home`` (once true for a row) and ``dealt``.

    Runs above BLOCK rows (in ``sizes``) are dealt as blocks against blocks, so every two rows meet.
    """
    blocks, own = F.col("blocks"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda j: F.struct((F.least(own, j) * blocks + F.greatest(own, j)).alias("cell"), (own == j).alias("home"))
    many = F.transform(F.sequence(F.lit(0), blocks - 1), pair)
    one = F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("home")))
    found = runs.join(sizes, "shingle", "left").withColumn("c", F.explode(F.when(blocks.isNull(), one).otherwise(many)))
    return found.select("*", "c.cell", "c.home", blocks.isNotNull().alias("dealt")).drop("blocks", "c")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, a hash of a text, and more) with that text; few rows more than wanted are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(marked(wanted, F.col("key")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = shared.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            hit = marks(keys)
            for k in np.flatnonzero(hit).tolist():
                key = int(keys[k])
                hit[k] = key not in seen  # a task sends a text once
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            yield batch.filter(pa.array(hit))

    found = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "key long, text string")
    return found.join(wanted, "key")


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, similar) for every node a behind its partner b, from rows sorted by partner, chunk and role."""
    hashes, key, other = WordHashes(), None, np.zeros(0, dtype=np.uint64)
    for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        rows = []
        for partner, chunk, role, node, text in zip(*map(values, part.columns), strict=True):
            own = shingle_set(words_of(text), hashes)
            if role == 0:
                key, other = (partner, chunk), own
            elif key == (partner, chunk):
                rows.append((node, partner, linked(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other))))
        if rows:
            a, b, ok = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok)], names=["a", "b", "similar"])


def compared(docs: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similar) for pairs of nodes; ``keys`` (node, key) has one text of each.

    A partner's text goes once to each chunk of the nodes that it is held against.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), "chunks").cast("int").alias("chunk"), "chunks")
    members = dealt.select(F.col("a").alias("node"), F.col("b").alias("partner"), "chunk", F.lit(1).alias("role"))
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    leaders = many.select(F.col("b").alias("node"), F.col("b").alias("partner"), chunk.alias("chunk"), F.lit(0).alias("role"))
    sends = members.union(leaders).join(keys.select("node", "key"), "node")
    sends = sends.groupBy("key").agg(F.collect_list(F.struct("partner", "chunk", "role", "node")).alias("to"))
    sends = staged(sends, "near-sends")
    rows = texts_of(docs, sends).select(F.explode("to").alias("t"), "text").select("t.*", "text")
    rows = rows.repartition("partner", "chunk").sortWithinPartitions("partner", "chunk", "role")
    rows = rows.select("partner", "chunk", "role", "node", "text")
    found = staged(rows.mapInArrow(_verified, "a long, b long, similar boolean").distinct(), "near-compared")
    discard(sends)
    return found


def similar_components(docs: DataFrame, keys: DataFrame, least: DataFrame, roots: DataFrame, components) -> DataFrame:
    """(node, root): ``roots`` (components of nodes known so far) joined by all links between texts of ``docs``.

    ``keys`` (node, key, parity) gives each node one of its texts and its sketch, ``least`` the prefixes by
    hash; ``components`` makes (node, root) of edges (a, b).
    """
    marks = frequent_marks(least)
    sent = prefixes(docs, marks).repartition("shingle").sortWithinPartitions("shingle", "node")
    runs = staged(sent.mapInArrow(_shared, "shingle long, node long, place long"), "near-runs")
    sizes = runs.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    sizes = staged(sizes.select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-sizes")
    failed, most = None, 1
    while True:
        rows = runs.join(keys.select("node", "parity"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if failed is None:
            rows = rows.withColumn("failed", F.lit(None).cast("array<long>"))
        else:
            rows = rows.join(failed.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed")), "node", "left")
        rows = cells(rows, sizes).select("shingle", "cell", "node", "place", "root", "home", "dealt", "parity", "failed")
        rows = rows.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell", "node")
        found = staged(rows.mapInArrow(_partnered(most), "shingle long, node long, place long, partner long"), "near-partners")
        discard(runs)
        runs = found.where("partner is null").select("shingle", "node", "place")
        runs._staged_path = found._staged_path  # noqa: SLF001
        pairs = staged(found.where("partner is not null").select(F.col("node").alias("a"), F.col("partner").alias("b")).distinct(), "near-pairs")
        if pairs.isEmpty():
            discard(runs, pairs, sizes)
            return roots
        done = compared(docs, keys, pairs)
        new = done.where("similar").select("a", "b").join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
        joined = components(new.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))  # of roots so far
        further = roots.join(joined.toDF("root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        fresh = joined.join(roots.select("node"), "node", "left_anti").where("node <> root")
        vain = done.where("not similar").select("a", "b")
        after = staged(further.union(fresh), "near-roots")
        tried = staged(vain if failed is None else failed.union(vain), "near-failed")
        discard(roots, pairs, done, *([failed] if failed is not None else []))
        roots, failed, most = after, tried, most * MORE
