"""Column functions against plain Python, on cases and on random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules, text as tx
from millrace.functions import align as al
from millrace.sources.formats import FORMATS, compile_format


def random_strings(n, alphabet, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(n)]


def apply(spark, strings, *columns):
    frame = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    return [tuple(r)[1:] for r in frame.select("i", *(c.alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()]


PIECES = ["<*>", "<*", "*>", "a", "B", "7", "é", " ", "\t", ".", ":", "/", "-", "#", "_", "0x1f", "12", '"', "'", "\n"]


def test_tokens_against_python(spark):
    strings = random_strings(800, PIECES)
    s = F.col("s")
    got = apply(spark, strings, tx.char_units(s), tx.word_units(s), tx.normalize_ws(s), tx.heuristic_template(s), tx.char_class(s))
    for x, (chars, words, spaced, heuristic, chars_of) in zip(strings, got, strict=True):
        assert chars == al.char_units(x)
        assert words == al.word_units(x, "-_/.")
        assert spaced == re.sub(r"\s+", " ", x.strip())
        assert heuristic == "".join("<*>" if re.search(r"\d", p) else p for p in re.split(r"(\W+)", x))
        assert chars_of == al.char_class(x)


def glued(s):
    out, run = [], ""
    for c in s + " ":
        if c.isalnum():
            run += c
        elif any(map(str.isalpha, run)):
            out.append(run)
            run = ""
    return out


def test_example_tokens(spark):
    strings = random_strings(500, ["a", "b", "1", "22", " ", ".", "-"]) + ["0 bytes", "12"]
    for x, (glue, plain) in zip(strings, apply(spark, strings, tx.example_tokens(F.col("s")), tx.example_tokens(F.col("s"), False)), strict=True):
        assert glue == glued(x)
        assert plain == [t for t in re.findall(r"[^\W_]+", x) if re.search("[a-z]", t)]


def test_merges_and_collapses(spark):
    strings = random_strings(800, ["<*>", "<*>", "a", " ", ".", ":", "#", "/", "@", '"', "'", "-"]) + ["<*> " * n + "<*>" for n in (9, 10, 14)]
    rows = apply(spark, strings, tx.merge_wilds(F.col("s")), rules.collapse(F.col("s")))
    steps = [("<*>.<*>", "<*>"), ("<*><*>", "<*>"), (" #<*># ", " <*> "), (" #<*> ", " <*> "), *((f"<*>{c}<*>", "<*>") for c in ":#/@."), (' "<*>" ', " <*> "), (" '<*>' ", " <*> "), ("<*><*>", "<*>")]
    for x, (merged, collapsed) in zip(strings, rows, strict=True):
        original = x
        for a, b in steps:
            while a in x:
                x = x.replace(a, b)
        assert collapsed == x
        assert merged == al.merge_wilds(original)
        assert merged.count("<*>") <= merged.count("<") and not re.search(r"<\*>[^\w ]*<\*>", merged)


def test_masks(spark):
    cases = {"at 10.0.0.1:80 ok": "at <*>:<*> ok", "mac ab:cd:01:ff.": "mac <*>.", "ptr 0xFF end": "ptr <*> end", "1 2 3": "<*> <*> <*>", "x12 -7 +8": "x12 <*> <*>", "id deadbeef cafebabe 00112233 z": "id <*> z", "A1B2 C3D4 E5F6 0011": "<*>", "é5": "é<*>"}
    assert [r[0] for r in apply(spark, list(cases), rules.mask_common(F.col("s")))] == list(cases.values())


def test_correction(spark):
    cases = {"read /var/log/a.b  from 12": "read <*> from <*>", "k=<*>x, y": "k=<*>, y", "<*>.<*>:<*>": "<*>"}
    assert [r[0] for r in apply(spark, list(cases), rules.correct_template(F.col("s")))] == list(cases.values())


def test_unwrap(spark):
    cases = {"<START>a<END>": "a", "b": "b", "x<START>c": "c", "<START>a<END> or <START>b<END>": "b", "<START><END>": None}
    frame = apply(spark, [*cases, None], tx.unwrap_response(F.col("s")), tx.is_yes(F.col("s")))
    assert [r[0] for r in frame] == [*cases.values(), None]


def test_template_to_regex(spark):
    strings = ["a <*> (b)", "x* [<*>]", "1+1=<*>?", "p|q^$"]
    for (pattern,), s in zip(apply(spark, strings, tx.template_to_regex(F.col("s"))), strings, strict=True):
        assert re.match(pattern, s.replace("<*>", "zz")) and not re.match(pattern, "other")


def test_strip_common_and_lcs(spark):
    a, b = random_strings(300, "ab<*> >", 3), random_strings(300, "ab<*> >", 4)
    frame = spark.createDataFrame(list(zip(range(300), a, b, strict=True)), "i int, a string, b string")
    rows = frame.select("i", tx.strip_common(F.col("a"), F.col("b")).alias("s"), tx.lcs_similarity(F.col("a"), F.col("b")).alias("l")).orderBy("i").collect()
    for x, y, r in zip(a, b, rows, strict=True):
        p, q = al.strip_common(x, y)
        assert (r.s.a, r.s.b) == (p if len(x) else "", q if len(y) else "")
        assert 0 <= r.l <= 1


def test_rewrite():
    assert rules.rewrite("size <*> MB (<*>)") == "size <*>" and rules.rewrite("http://<*>:<*>") == "<*>"
    assert rules.rewrite(None) is None and len(rules.EQUIVALENT_PAIRS) == 22 and len(rules.REWRITES) == 40


@pytest.mark.parametrize("name", sorted(FORMATS))
def test_formats_compile_alike(spark, name):
    form = compile_format(FORMATS[name])
    fields = re.findall("<([^<>]+)>", FORMATS[name])
    assert list(form.groups) == fields
    assert re.compile(form.pattern).groups >= len(fields)
    spark.sql("select 'x' rlike r'" + form.pattern.replace("'", "\\'") + "'").collect()


def test_optional_groups(spark):
    form = compile_format(FORMATS["Linux"])
    got = apply(spark, ["Jun 14 15:16:01 combo sshd(pam)[19939]: check pass", "Jun 14 15:16:01 combo su: x"], *form.fields(F.col("s")))
    assert got[0] == ("Jun", "14", "15:16:01", "combo", "sshd(pam)", "19939", "check pass")
    assert got[1][4:] == ("su", "", "x")
