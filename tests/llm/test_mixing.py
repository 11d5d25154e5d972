"""Budgets by hand, selections by brute force, and defined cases."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, epoch int, n_tokens string"


def brute_split(budget, children):
    """children: (name, weight, capacity); raise a common level until the budget or all children are full."""
    open_, out, left = dict((n, (w, c)) for n, w, c in children), {}, budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= left * w]
        if not full:
            return out | {n: left * w // total for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[1]
        left = budget - sum(out[n] for n in out)
    return out


def test_split_redistributes_among_siblings(spark):
    rows = [("a", "x", 10, 100), ("a", "y", 500, 100), ("a", "z", 30, 100), ("b", "x", 7, 1000), ("b", "y", 9, 1000)]
    frame = spark.createDataFrame(rows, "domain string, lang string, capacity long, budget long")
    weights = {"x": 3, "y": 1, "z": 2}
    got = {(r.domain, r.lang): r.alloc for r in mixing.split(frame, ["domain"], "lang", mixing.weight(F.col("lang"), weights, 5)).collect()}
    for parent in "ab":
        mine = [(n, weights[n], c) for p, n, c, _ in rows if p == parent]
        want = brute_split(rows[0][3] if parent == "a" else 1000, mine)
        assert {n: got[parent, n] for n, *_ in mine} == want
    assert got == {("a", "x"): 10, ("a", "y"): 60, ("a", "z"): 30, ("b", "x"): 7, ("b", "y"): 9}


def brute_select(rows, plan, allocations):
    leaves, out = defaultdict(list), []
    for d, leaf, n in rows:
        leaves[leaf].append((d, n))
    for leaf, docs in leaves.items():
        total, alloc = sum(n for _, n in docs), allocations[leaf]
        epochs, rest = divmod(alloc, total) if total else (0, 0)
        out += [(d, e) for e in range(epochs) for d, _ in docs]
        key = lambda d: (hashlib.md5(f"{plan.seed}:{epochs}:{d}".encode()).hexdigest()[:15], d)
        used = 0
        for d, n in sorted(docs, key=lambda x: key(x[0])):
            used += n
            if rest and used <= rest:
                out.append((d, epochs))
    return sorted(out)


def test_selection_against_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), "en" if i % 3 else "de", f"src{i % 2 * 6}", 0, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixing.RANGE, old = 7, mixing.RANGE
    try:
        for share in (30, 90, 180, 400):
            plan = mixing.Plan(share_percent=share, max_epochs=3)
            base = mixing.counted(docs).cache()
            leaves = base.groupBy(*mixing.LEAF).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
            allocations = {(r.domain, r.lang, r.source): r.alloc for r in mixing.allocate(leaves, plan).collect()}
            total = sum(len(t.split()) for _, t, *_ in rows)
            assert abs(sum(allocations.values()) - min(total * share // 100, 3 * total)) <= 8
            mine = [(i, ("forum" if s == "src6" else "web", lang, s), len(t.split())) for i, t, lang, s, *_ in rows]
            got = mixing.select(docs, plan)
            assert sorted((r.doc_id, r.epoch) for r in got.collect()) == brute_select(mine, plan, allocations)
            kept = mixing.mixed(docs, plan)
            assert kept.columns == docs.columns and kept.count() == got.count()
    finally:
        mixing.RANGE = old


def test_defined_cases(spark):
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "src1", 0, "x"), (3, "a b", "en", "src1", 0, "x"), (3, "a b", "en", "src1", 0, "x"), (None, "z " * 300_000, "fr", "odd", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    full = mixing.select(docs, mixing.Plan(share_percent=100, max_epochs=1)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in full if r.n_tokens) == [(0, 300_000), (3, 2), (3, 2)]
    assert mixing.select(docs, mixing.Plan(share_percent=0)).count() == 0
    assert mixing.select(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()
    assert mixing.mixed(docs, mixing.Plan(share_percent=100, max_epochs=1)).columns == docs.columns


def test_weight_of_zero_takes_nothing(spark):
    rows = [(i, "w w w", "en" if i % 2 else "xx", f"src{i % 3}", 0, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.Plan(languages={"en": 1, "xx": 0}, share_percent=100, max_epochs=1)
    got = mixing.select(docs, plan).collect()
    assert {r.lang for r in got} == {"en"} and len(got) == 30
    assert mixing.select(docs, mixing.Plan(domains={"web": 0}, default=0)).count() == 0
