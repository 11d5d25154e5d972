"""Line dedup against a plain Python version, collisions, and defined cases."""

import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import linededup

SCHEMA = "doc_id long, text string, chunks int"


def chunks_of(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    long = [x.count(" ") + 1 >= 50 for x in lines]
    hit = [((h[i - 1] if i else 0) >> 1 ^ h[i]) & 1 == 0 for i in range(len(lines))]
    out = []
    for i, x in enumerate(lines):
        if not i or long[i - 1] or long[i] or (2 <= i < len(lines) - 1 and hit[i] and not hit[i - 1]):
            out.append([])
        out[-1].append(x)
    return out


def brute(rows):
    seen, out = {}, []
    for d, t in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0])):
        for n, c in enumerate(chunks_of(t)):
            if len(c) > 1 or c[0].count(" ") + 1 >= 50:
                seen.setdefault(tuple(c), (d, t, n))
    for d, t in rows:
        if t is None:
            out.append((d, None, None, None, None))
            continue
        kept, cut = [], 0
        for n, c in enumerate(chunks_of(t)):
            if (len(c) > 1 or c[0].count(" ") + 1 >= 50) and seen[tuple(c)] != (d, t, n):
                cut += 1
            else:
                kept += c
        lines = len(t.split("\n"))
        out.append((d, "\n".join(kept), lines, lines - len(kept), cut))
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(4))) for _ in range(12)] + [" !x", "!", " ", "long " * 55, "é " * 49]
    block = [f"shared line {i}" for i in range(9)]
    rows = []
    for i in range(n):
        lines = [rnd.choice(pool) if rnd.random() < 0.5 else f"own {i} {k}" for k in range(rnd.randrange(1, 12))]
        if rnd.random() < 0.5:
            at = rnd.randrange(len(lines) + 1)
            lines[at:at] = block
        rows.append((i, "\n".join(lines)))
    return rows


def run(spark, rows):
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    return sorted(map(tuple, linededup.dedup(frame).collect()), key=str)


def test_against_plain_version(spark):
    rows = corpus(1, 150) + [(200, None), (201, ""), (202, "\n\n\n"), (None, "shared line 0\nshared line 1\nshared line 2\nshared line 3"), (5, corpus(1, 150)[5][1]), (300, "\n".join(["own 1 1"] * 5000)), (301, "w " * 100_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[4] or 0 for r in got) > 50
    assert linededup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    """With a hash of two values almost every group is a collision."""
    rows = corpus(2, 40)
    real = F.xxhash64
    weak = lambda *c: (F.abs(real(*c)) % 2) if c == ("chunk",) else real(*c)
    monkeypatch.setattr(linededup.F, "xxhash64", weak)
    assert run(spark, rows) == brute(rows)


def test_inserted_lines_shift_no_far_boundary():
    lines = [f"line {i}" for i in range(60)]
    plain = chunks_of("\n".join(lines))
    shifted = chunks_of("\n".join(["new", *lines]))
    assert plain[3:] == shifted[-len(plain[3:]) :]


def test_passages_of_short_lines_go():
    """A repeated passage of many lines loses all but a few lines at its ends, whatever stands around it."""
    rnd, kept = random.Random(9), 0
    passage = [" ".join(f"w{rnd.randrange(999)}" for _ in range(6)) for _ in range(30)]
    for k in range(200):
        around = lambda: [f"own {k} {rnd.random()}" for _ in range(rnd.randrange(1, 9))]
        one, two = ({"\n".join(c) for c in chunks_of("\n".join(around() + passage + around())) if len(c) > 1} for _ in range(2))
        kept += 30 - sum(c.count("\n") + 1 for c in one & two)
    assert kept < 200 * 8
