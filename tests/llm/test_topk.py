"""Threshold algorithm against brute force."""

import numpy as np

from millrace.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k=10, every=100):
    ok = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out, done = [], set()
    for q, x in ok:
        if q % every == 0 and (q, tuple(x)) not in done:
            done.add((q, tuple(x)))
            found = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=8).round(2).tolist()) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(1000, 1300)]  # a third of all rows alike
    rows += [(i, rnd.normal(size=3).tolist()) for i in range(2000, 2150)]
    rows += [(3000, None), (3001, []), (3002, [1.0, None]), (3003, [float("nan")] * 8), (3004, [float("inf")] * 8), (None, [1.0] * 8), (3100, [0.0] * 8), (5, rows[5][1]), (4000, [1.0, 2.0, 3.0, 4.0, 5.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    topk.SHARD, old = 128, topk.SHARD
    try:
        got = sorted(tuple(r) for r in topk.search(frame).collect())
    finally:
        topk.SHARD = old
    assert got == brute(rows)
    assert topk.search(frame.limit(0)).count() == 0


def test_one_query_id_with_two_vectors_and_no_move_by_length(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.75]), (3, [0.1, 0.1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in topk.search(frame, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 768 * 1024), (0, 2, 1, 512 * 1024), (0, 3, 1, 256 * 1024)]
    plan = topk.search(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression [dim#" in plan and ", shard#" in plan


def test_reading_stops_early():
    rnd = np.random.default_rng(4)
    rows = (rnd.gamma(0.2, size=(20_000, 3)) * 1000).astype(np.int64)
    lists = topk.SortedLists(np.arange(20_000), rows)
    query = np.array([3, 1, 2])
    got = lists.best(-1, query, 5)
    want = sorted((-int(s), i) for i, s in enumerate(rows @ query))[:5]
    assert got == [(i, -s) for s, i in want] and lists.read < 5_000
