"""Every registered query of the miner gives the rows of its SQL."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from millrace.functions import align as al
from millrace.operators.sampling import synth_positive
from millrace.plans import views as v
from millrace.plans.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def brute_cover(tables):
    """All pairs of distinct texts and templates of parts, numbered in order."""
    rows = sorted({x for (x,) in tables.sql("select concat(p_name, ' / ', p_type, ' / <*>') from part union select concat(p_name, ' / ', p_type, ' / ', p_brand) from part").fetchall()})
    return [(i, j) for j in range(len(rows)) for i in range(j) if al.covers(rows[i], rows[j])]


def brute_align(tables):
    out = []
    for line, text in tables.sql(f"select LineId, Content from {v.EVENTS_SQL}").fetchall():
        fitted, contents, classes = al.wild_align(re.sub(r"\d+", "<*>", text), text)
        out.append((line, "|".join(contents), len(classes), fitted))
    return out


def brute_merge(tables):
    texts = dict(tables.sql(f"select id, text from {v.PARTS_SQL}").fetchall())
    merged = {i: al.merge_templates(texts[i], texts[i + 1]) for i in texts if i + 1 in texts}
    return [(len(gaps), i, template) for i, (template, gaps) in merged.items()]


def brute_synth(tables):
    rows = tables.sql(f"select id, template, text from {v.PARTS_SQL}").fetchall()
    return [(i, synth_positive(template, text, i), text) for i, template, text in rows]


def brute_mined(tables):
    """The heuristic's answer for an event is its text with digits masked."""
    texts = [re.sub(r"\d+", "<*>", x) for (x,) in tables.sql(f"select Content from {v.EVENTS_SQL}").fetchall()]
    return list(Counter(texts).items())


#: Queries without SQL, and their rows by plain Python.
PLAIN = {"cover_join": brute_cover, "wild_align": brute_align, "merge_templates": brute_merge, "synth_positive": brute_synth, "online_parse": brute_mined}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    if name in ORACLE:
        want = tables.sql(ORACLE[name])
        assert sorted(want.columns) == columns
        quoted = [f'"{c}"' for c in columns]
        want = want.select(*quoted).fetchall()
    else:
        want = PLAIN[name](tables)
    assert got == sorted((tuple(r) for r in want), key=str)
    assert got
