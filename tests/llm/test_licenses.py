"""License templates and base phrases."""

import itertools
import random
import re

from millrace.llm import licenses as li


def label(text):
    return li.examine(text, li.index(li.TEMPLATES))


def test_markup():
    a = li.compile_template("one <<optional>>two <<optional>>three<</optional>><</optional>> four <<any 2>> five")
    accepted = lambda t: a.accepts(t.split(), 0)
    assert accepted("one four five") == 3 and accepted("one two four x five") == 5
    assert accepted("one two three four x y five z") == 7
    assert accepted("one three four five") is None and accepted("one four x y z five") is None
    assert li.compile_template("<<optional>>a<</optional>> b").starts == {"a", "b"}


def test_notices():
    assert label("x. Released under the MIT License.")[5] == "mit,mit-notice"
    assert label("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl,gpl-notice"
    assert label("Licensed under the Apache License, Version 2.0.")[5] == "apache,apache-2.0"
    assert label("the apache-license and MIT\tLICENSE, mit license")[:7] == (8, 3, 1, 6, "apache,mit", "apache,mit", 0.5)
    assert label("LICENSED UNDER CC BY-NC 4.0")[5] == "cc-by-nc"
    plain = lambda name: re.sub("<<any [0-9]+>>", "Some One", re.sub("<</?optional>>", "", li.TEMPLATES[name]))
    for name in li.TEMPLATES:
        assert name in label(f"Text before it. {plain(name)}. Text behind it.")[5].split(",") or name == "lgpl-header", name
    body = plain("mit-text")
    assert label(body)[5] == "mit-text" and label(body.replace("hereby", "thereby"))[5] == ""
    assert label(plain("bsd-3-clause"))[5] == "bsd-3-clause" and label(plain("bsd-2-clause"))[5] == "bsd-2-clause"
    assert label("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.")[5] == "gpl,lgpl-header"
    assert label("All rights reserved to nobody")[5:7] == ("", 0.0)
    assert label("Copyright 2020 Some One. All rights reserved.")[5] == "all-rights-reserved"
    # One notice is one match, the longest.
    assert label("This work is released under the MIT License.")[7] == "mit-notice:0:8"


def expanded(markup, fill):
    """All word sequences of a template, with words of ``fill`` for any word."""
    m = re.search(r"<<optional>>((?:(?!<<optional>>).)*?)<</optional>>", markup, re.S)
    if m:
        return expanded(markup[: m.start()] + markup[m.end() :], fill) | expanded(markup[: m.start()] + " " + m[1] + " " + markup[m.end() :], fill)
    m = re.search(r"<<any (\d+)>>", markup)
    if m:
        several = [c for k in range(int(m[1]) + 1) for c in itertools.product(fill, repeat=k)]
        return {w for c in several for w in expanded(markup[: m.start()] + f" {' '.join(c)} " + markup[m.end() :], fill)}
    return {tuple(markup.split())}


def test_automata_against_expansion():
    rnd = random.Random(7)
    for _ in range(150):
        markup, depth = "a", 0
        for _ in range(rnd.randrange(2, 7)):
            piece = rnd.choice(["a", "b", "c", "<<any 2>>", "<<optional>>", "<</optional>>"])
            if piece == "<</optional>>" and not depth:
                continue
            depth += {"<<optional>>": 1, "<</optional>>": -1}.get(piece, 0)
            markup += " " + piece
        markup += " <</optional>>" * depth
        automaton, accepted = li.compile_template(markup), expanded(markup, "abc")
        for _ in range(40):
            words = [rnd.choice("abc") for _ in range(rnd.randrange(1, 7))]
            want = max((n for n in range(len(words) + 1) if tuple(words[:n]) in accepted), default=None)
            assert automaton.accepts(words, 0) == want, (markup, words)


def test_phrases_against_brute_force():
    rnd = random.Random(6)
    for _ in range(500):
        words = [rnd.choice(["mit", "license", "apache", "general", "public", "x"]) for _ in range(rnd.randrange(15))]
        want = sorted((i, lab) for p, lab in li.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
        assert sorted(li.phrases(words)) == want


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é MIT license", 0), (3, "é MIT license", 0), (None, "w " * 200_000 + "mit license", 0)]
    got = sorted(li.scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect(), key=lambda r: (r.doc_id or 9))
    assert [r.n_words for r in got] == [0, 0, 3, 3, 200_002] and got[0].first_word is None and got[0].labels == ""
    assert got[4].first_word == got[4].last_word == 200_000
    assert li.scan(spark.createDataFrame([], "doc_id long, text string, n_words int")).count() == 0
