"""SimHash groups against brute force."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from millrace.llm import setjoin, simhash
from millrace.llm.base import WordHashes, signed

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """prints: list of (doc_id, fp); the component of each."""
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted((d if d is not None else -1, least.get(root(i), -1)) for i, (d, _) in enumerate(prints))


def test_fingerprint_matches_definition():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = "\n".join(" ".join(rnd.choice(["Été", "the", "Cat", "x1"]) for _ in range(5)) for _ in range(n))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0


def test_tree_finds_what_brute_force_finds():
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    values = {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(200)} | {rnd.getrandbits(64) for _ in range(200)}
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for v in list(values)[:50]:
        assert {tree.values[i] for i in tree.within(v, 2)} == {w for w in values if (v ^ w).bit_count() <= 2}


def test_groups_match_brute_force(spark):
    rnd = random.Random(3)
    centre, prints = rnd.getrandbits(64), []
    for i in range(700):  # a crowd around one point makes a shard that is dealt again
        x = centre
        for _ in range(rnd.randrange(5)):
            x ^= 1 << rnd.randrange(40)
        prints.append((i, x))
    for i in range(700, 800):
        x = rnd.getrandbits(64)
        prints += [(i, x), (i + 1000, x ^ 1 << rnd.randrange(64))]
    prints += [(5000, 0), (5001, 0), (5002, 3), (5003, 15), (None, 0), (None, 7 << 60)]
    frame = spark.createDataFrame([(d, signed(x)) for d, x in prints], "doc_id long, fp long").cache()
    old, simhash.SPLIT = simhash.SPLIT, 20
    try:
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in simhash.grouped(frame).collect())
    finally:
        simhash.SPLIT = old
    assert got == brute_groups(prints)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, "A b c d", "x"), (2, "a B c d", "y"), (2, "a b c d", "y"), (3, None, "z"), (4, "", None), (5, long, "q"), (6, long, "q"), (None, "a b c d", "n"), (7, "other words in here", "o"), (7, "other words in here", "o")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (-1, 1), (7, 7), (7, 7)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def test_chain_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200)]
    rnd = random.Random(4)
    name = list(range(300))
    rnd.shuffle(name)
    frame = spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in simhash.components(frame).collect()}
    chain = {name[i] for i in range(41)}
    assert {got[x] for x in chain} == {min(chain)}
    assert len({got[name[i]] for i in (100, 101, 102)}) == 1


def test_components_step_only_while_edges_are_no_stars(spark, monkeypatch):
    """Stars around their least nodes are stored once and left; random graphs match a union-find."""
    made, stored = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, label: made.append(label) or stored(df, label))
    stars = [(i, 1 + i % 2) for i in range(3, 40)] + [(5, 5)]
    for edges in (stars, [(b, a) for a, b in stars], []):
        made.clear()
        got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == ({i: 1 + i % 2 for i in range(3, 40)} | {1: 1, 2: 2} if edges else {})
        assert made == ["star"]
    for seed in range(4):
        rnd = random.Random(seed)
        edges = [(rnd.randrange(-20, 40), rnd.randrange(-20, 40)) for _ in range(12 + 10 * seed)]
        root = {x: x for e in edges for x in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        rows = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
        apart = {x for e in edges for x in e if e[0] != e[1]}
        assert sorted((r.node, r.root) for r in rows) == sorted((x, root[x]) for x in apart)


def test_staged_tables_are_only_their_rows(spark):
    """No marker file beside the rows: on a local file system each costs two processes that the driver starts."""
    frame = simhash.staged(spark.range(10).toDF("a"), "test-marker")
    assert sorted(r.a for r in frame.collect()) == list(range(10))
    names = {p.name.split("-")[0] for p in Path(frame._staged_path.removeprefix("file:")).iterdir()}
    assert names == {"part", ".part"}
    simhash.discard(frame)


def near_corpus(seed, families, copies):
    """Texts with copies in which one word of forty or so is changed, all with a shared passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage, out = [word() for _ in range(60)], []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([20, 50, 75, 150, 400]))]
        if rnd.random() < 0.5:
            base += passage
        out.append(" ".join(base))
        for _ in range(copies):
            rate = rnd.choice([0.004, 0.015, 0.03])
            out.append(" ".join(word() if rnd.random() < rate else w for w in base))
    rnd.shuffle(out)
    return out


def brute_similar(texts):
    """Components of (fingerprints within 2 bits, or Jaccard of 0.8 on five-word shingles)."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    prints, group = [simhash.fingerprint(t) for t in texts], list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_similar_groups_against_brute_force(spark, monkeypatch):
    """Every group, whatever is frequent, and however runs and comparisons are dealt."""
    texts = near_corpus(9, 40, 6)
    want = dict(enumerate(brute_similar(texts)))
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    for frequent, block, chunk in ((32, 20_000, 1_000), (2, 3, 2)):
        monkeypatch.setattr(setjoin, "FREQUENT", frequent)
        monkeypatch.setattr(setjoin, "BLOCK", block)
        monkeypatch.setattr(setjoin, "CHUNK", chunk)
        assert {r.doc_id: r.group for r in named(simhash.similar_groups(docs))} == want
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i in want if want[i] == i}


def named(groups):
    """The groups with their least doc_id as name."""
    least = groups.groupBy("group").agg(F.min("doc_id").alias("least"))
    return groups.join(least, "group").select("doc_id", F.col("least").alias("group")).collect()


def chains(rnd, families, steps):
    """Drifting versions, each similar to the one before it and not to those further off."""
    out = []
    for _ in range(families):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
        for _ in range(steps):
            for at in rnd.sample(range(150), 3):
                words[at] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(words))
    rnd.shuffle(out)
    return out


def test_chains_and_borderline_pairs(spark):
    rnd = random.Random(12)
    texts = chains(rnd, 4, 30)
    base = [f"w{k}" for k in range(104)]  # 100 shingles; five lost and five gained for each changed word
    for changes in range(1, 6):
        words = list(base)
        for at in range(10, 10 + 20 * changes, 20):
            words[at] = f"y{at}{changes}"
        texts.append(" ".join(words))
    texts += [" ".join(base), " ".join(base + 2 * base[:20]), "a b c", "a b c d", "a b c", "A  B\tc"]
    want = dict(enumerate(brute_similar(texts)))
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.group for r in named(simhash.similar_groups(docs))} == want


def test_partners_leave_no_pair_out():
    """Rounds over random runs compare or connect every possible pair, whatever the comparison says."""
    rnd = random.Random(14)
    for _ in range(200):
        nodes = sorted(rnd.sample(range(100), rnd.randrange(2, 12)))
        sizes = {x: rnd.choice([9, 10, 11, 20]) for x in nodes}
        runs = [sorted(rnd.sample(nodes, rnd.randrange(2, len(nodes) + 1))) for _ in range(rnd.randrange(1, 4))]
        spots = [{x: rnd.randrange(3) for x in run} for run in runs]
        alike = {(a, b): rnd.random() < 0.2 for a in nodes for b in nodes if b < a}
        possible = set()
        for run, at in zip(runs, spots, strict=True):
            for i, b in enumerate(run):
                for a in run[i + 1 :]:
                    n, m = sizes[a], sizes[b]
                    if 5 * min(n, m) >= 4 * max(n, m) and 9 * min(n - at[a], m - at[b]) >= 4 * (n + m):
                        possible.add((a, b))
        root, failed, compared, most = {x: x for x in nodes}, {}, set(), 1
        while True:
            ids = np.array([k for k, run in enumerate(runs) for _ in run])
            node = np.array([x for run in runs for x in run])
            place = np.array([sizes[x] << 32 | at[x] for run, at in zip(runs, spots, strict=True) for x in run])
            found = setjoin.partners(ids, node, place, np.array([root[x] for x in node.tolist()]), np.zeros((len(node), 8), dtype=np.int64), failed, most)
            pairs, most = {(int(node[k]), int(node[p])) for k, p in zip(*found, strict=True)}, most * 2
            if not pairs:
                break
            assert pairs <= possible and not pairs & compared
            compared |= pairs
            for a, b in pairs:
                if alike[a, b]:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {x: new if r == old else r for x, r in root.items()}
                else:
                    failed.setdefault(a, set()).add(b)
        assert all((a, b) in compared or root[a] == root[b] for a, b in possible)


def test_batches_cut_anywhere_give_the_same_runs():
    rnd = random.Random(15)
    rows = sorted((rnd.randrange(12), rnd.randrange(6), 9 << 32) for _ in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["shingle", "node", "place"])
    distinct = sorted(set(rows))
    want = [r for r in distinct if sum(r[0] == o[0] for o in distinct) > 1]
    for _ in range(50):
        cuts = sorted({0, 60, *(rnd.randrange(60) for _ in range(rnd.randrange(12)))})
        parts = [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [tuple(r.values()) for b in setjoin._shared(iter(parts)) for r in b.to_pylist()]
        assert got == want
        tables = [t.to_pylist() for t in setjoin._whole_runs(iter(parts))]
        assert [tuple(r.values()) for t in tables for r in t] == rows
        keys = [{(r["shingle"], r["node"]) for r in t} for t in tables]
        assert all(not a & b for i, a in enumerate(keys) for b in keys[:i])


def test_sets():
    hashes = WordHashes()
    of = lambda t: setjoin.shingle_set(setjoin.words_of(t), hashes)
    assert len(of("a b c d e f")) == 2 and len(of("a b")) == 1 and len(of(None)) == 0
    assert setjoin.name_of(of("a b c d e a b c d e")) == setjoin.name_of(of("A b c d e  a b c d e a b c d e"))
    assert setjoin.name_of(of("")) == setjoin.EMPTY
    one, two = of("a b c d e f g h i j"), of("a b c d e f g h x j")
    apart = sum((x ^ y).bit_count() for x, y in zip(*(setjoin.parity(s).view(np.uint64).tolist() for s in (one, two)), strict=True))
    assert 0 < apart <= len(np.setxor1d(one, two)) and apart % 2 == len(np.setxor1d(one, two)) % 2
    # Linked sets always meet in their prefixes: the shared part cannot avoid both.
    for n in range(1, 60):
        for m in range(n, 60):
            least = next((c for c in range(n + 1) if setjoin.linked(c, n, m)), None)
            if least is not None:
                assert setjoin.prefix_length(n) > n - least and setjoin.prefix_length(m) > m - least
