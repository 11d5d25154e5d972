"""Nearest lines of another template, many at a time."""

import random

import pytest

from millrace.functions import distance
from millrace.operators.sampling import fits, hard_negatives, hard_negatives_near, pairs_near
from millrace.plans.queries import QUERIES


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("cells", [distance.CELLS, 50])
def test_edit_distances(monkeypatch, cells):
    monkeypatch.setattr(distance, "CELLS", cells)
    r = random.Random(1)
    for _ in range(30):
        letters = "ab\0é𝄞€xyz"[: r.randint(1, 9)]
        text = lambda: "".join(r.choices(letters, k=r.choice([0, 1, 5, 30, 63, 64, 65, 127, 128, 129, 200])))  # noqa: B023, E731
        a, b = ([text() for _ in range(r.randint(0, 5))] for _ in "ab")
        b += [x[: len(x) // 2] + "é" + x[len(x) // 2 :] for x in a]
        assert distance.edit_distances(a, b).tolist() == [[plain_distance(x, y) for y in b] for x in a]


def test_fits_as_the_expression_does(spark):
    templates = ["a <*> b", "a<*>", "<*>", "a.b*[c]", "<*><*> x\r", "", "<*>\n<*>", "a <*"]
    texts = ["a 1 b", "a  b", "a 1 b\n", "a\n b", "a.b*[c]", "axb*[c]", "ab x\r\n", "ab x\r", "", "\n", "a\nb", "a ", "a\x85\n", "a <*", "𝄞"]
    rows = spark.createDataFrame([(t, x) for t in templates for x in texts], "template string, n_text string")
    from millrace.operators.sampling import with_regex

    found = with_regex(rows).selectExpr("template", "n_text", "n_text rlike regex as fits").collect()
    assert [fits(r.template, r.n_text) for r in found] == [r.fits for r in found]


@pytest.mark.parametrize("reach,extra", [(50, 32), (3, 0), (1, 500)])
def test_nearest_of_another_template(spark, reach, extra):
    r = random.Random(reach)
    templates = ["job <*> done", "job <*>", "<*> done", "no wildcard", None]
    rows = [(-7, "job 1 done", "job <*>"), (10**12, "job 1 done", "job <*>")]
    for i in r.sample(range(900), 500):
        template = r.choice(templates)
        text = r.choice([None, "", "job 1\n", (template or "job <*>").replace("<*>", str(r.randint(0, 10 ** r.randint(0, 90))))])
        rows.append((i, text, template))
    rows.append((None, "job 1 done", "no wildcard"))
    lines = spark.createDataFrame(rows, "id long, text string, template string")
    queries = lines.where("id is null or id % 3 <> 0")
    want = sorted(tuple(x) for x in hard_negatives(pairs_near(lines, queries, reach, extra, 5)).collect())
    assert sorted(tuple(x) for x in hard_negatives_near(lines, queries, reach, extra, 5).collect()) == want
    assert want


def test_hard_negative_makes_no_row_of_a_pair(spark):
    plan = QUERIES["hard_negative"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan and "levenshtein" not in plan
