"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are dealt into shards of about ``SHARD`` rows. A shard's task sorts the rows
once for each dimension; then the queries, which the shuffle sorts behind the
shard's vectors, stream past. For a query the lists are read in step, from the top
where its component is positive and from the bottom where it is negative; every row
met for the first time is scored in full. Reading stops when k rows score above the
bound that no unread row can exceed: the query's product with the last values read.
Ties count as not beaten, so they are read on and go to the smaller id. The shards'
k best per query meet in one ranking.

Values are integers, so scores are exact; components must stay small enough for
64-bit products. Queries are the rows whose id ``EVERY`` divides, against all rows.

Defined cases: vectors null, empty, or holding null or non-finite components, and
rows without an id, take no part; vectors of unlike length are never compared; a
repeated query row is answered once; query rows with one id and different vectors are
one query, whose answers are ranked together, the best of either first (a row that both
find can stand twice); rows with the query's own id are no candidates,
other repeated rows are candidates each; an empty table gives no rows; other columns
are ignored.

The rows are stored once, quantised. Each shard gets each query, N / 100 times N / 8,192
vectors in all: a stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import staged

K = 10
EVERY = 100
SCALE = 1024
#: Vectors of a shard.
SHARD = 8_192
#: Entries read from each list before the bound is first looked at; doubled each time.
DEPTH = 16


class SortedLists:
    """A shard's vectors with one sorted list of rows per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], np.ascontiguousarray(rows[by_id])
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.read = 0

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows, by falling score and then rising id."""
        n = len(self.ids)
        fresh = self.ids != query_id
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen_rows, seen_scores, count, at, depth = [], [], 0, 0, DEPTH
        while at < n:
            to = min(n, depth)
            met = np.zeros(n, dtype=bool)
            met[self.order[n - to : n - at, up].ravel()] = True
            met[self.order[at:to, down].ravel()] = True
            if to == n:  # the lists end, or the query is zero: everything is met
                met[:] = True
            new = np.flatnonzero(met & fresh)
            fresh[new] = False
            seen_rows.append(new)
            seen_scores.append(self.rows[new] @ query)
            count += len(new)
            at, depth = to, 2 * depth
            if count >= k and at < n:
                bound = self.rows[self.order[n - at, up], up] @ query[up] + self.rows[self.order[at - 1, down], down] @ query[down]
                scores = np.concatenate(seen_scores)
                if np.partition(scores, len(scores) - k)[len(scores) - k] > bound:
                    break
        self.read += count
        rows, scores = np.concatenate(seen_rows), np.concatenate(seen_scores)
        if len(rows) > k:
            held = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[held], scores[held]
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(self.ids[rows[first]].tolist(), scores[first].tolist(), strict=True))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of ``scale`` times each component, of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select("vec_id", x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
        .where(good)
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


def _answers(k: int):
    names = ["query_id", "vec_id", "score"]

    def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dim)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists, ids, rows = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, shard, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (dim[a], shard[a]) != key:
                    key, lists, ids, rows = (dim[a], shard[a]), None, [], []
                part_ids = batch.column(3).slice(a, b - a).to_numpy()
                part = matrix(batch.column(4).slice(a, b - a), int(dim[a]))
                if kind[a] == 0:
                    ids.append(part_ids)
                    rows.append(part)
                    continue
                if lists is None and ids:
                    lists = SortedLists(np.concatenate(ids), np.concatenate(rows))
                for q, query in zip(part_ids.tolist(), part, strict=True):
                    out += [(q, i, s) for i, s in (lists.best(q, query, k) if lists else [])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows."""
    rows = staged(quantised(vectors, scale).withColumn("dim", F.size("v")), "topk-rows")
    # One number decides how many shards every length of vectors has; rows are never moved by length.
    largest = rows.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(1, -(-largest // SHARD))
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    candidates = rows.select("dim", place.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    sorted_rows = candidates.union(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = sorted_rows.mapInArrow(_answers(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
