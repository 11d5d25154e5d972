"""Decontamination: planted items, other numbers and names, slot consistency, brute force."""

import random

from millrace.llm import decontam as d

DOC, ITEM = "doc_id long, text string, hash string", "item_id long, text string, place int"
QUESTION = "At the market Anna Smith bought 12 apples and 30 pears, then she gave 12 of the apples to Peter before walking 5 km to the old station."
OTHER = "At the market Maria bought 7 apples and 45 pears, then she gave 7 of the apples to John Miller before walking 9 miles to the old station."
BROKEN = "At the market Maria bought 7 apples and 45 pears, then she gave 8 of the apples to John Miller before walking 9 miles to the old station."


def brute(docs, items, window=d.WINDOW):
    """The share of each item's windows that a document holds, exact tokens only (texts without slots)."""
    out = set()
    for doc_id, text in docs:
        have = d.template(text)[0]
        for item_id, item in items:
            tokens = d.template(item)[0]
            if len(tokens) < d.SHORTEST:
                continue
            size = min(window, len(tokens))
            cut = lambda t: {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
            want = cut(tokens)
            hit = len(want & cut(have))
            if hit and (hit / len(want) >= d.COVERAGE):
                out.add((doc_id, item_id, hit))
    return out


def test_templates():
    tokens, values = d.template("The city of New York has 3,000 miles of roads. He paid 5 $ (five dollars).")
    assert tokens == ["the", "city", "of", "<a>", "has", "<n>", "<u>", "of", "roads", "he", "paid", "<n>", "<u>", "<n>", "<u>"]
    assert values[3] == "new york" and values[5] == "3,000" and values[0] is None
    assert d.template(None) == ([], []) == d.template(" .\n")


def test_parameters_may_change_but_consistently(spark):
    noise = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    docs = [(1, QUESTION), (2, noise + ". " + OTHER + " " + noise), (3, BROKEN), (4, noise), (5, None), (6, ""), (7, QUESTION[:40]), (None, QUESTION), (1, QUESTION), (8, noise * 3000 + " " + OTHER)]
    frame = spark.createDataFrame([(i, t, "h") for i, t in docs], DOC)
    items = spark.createDataFrame([(10, QUESTION, 1), (11, QUESTION, 1), (12, "too short", 1), (None, noise, 1), (13, None, 1)], ITEM)
    got = {(r.doc_id, r.item_id, r.exact) for r in d.contaminated(frame, items).collect()}
    assert got == {(1, 10, True), (2, 10, False), (None, 10, True), (8, 10, False)}
    kept = d.clean(frame, items)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert d.contaminated(frame.limit(0), items).count() == 0
    assert d.contaminated(frame, items.limit(0)).count() == 0


def test_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(2, 40)))) for i in range(30)]
    docs = []
    for i in range(200):
        words = [word() for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.6:
            item = rnd.choice(items)[1].split()
            a = rnd.randrange(len(item))
            words[len(words) // 2 : len(words) // 2] = item[a:] if rnd.random() < 0.5 else item
        docs.append((i, " ".join(words)))
    got = d.contaminated(spark.createDataFrame([(i, t, "") for i, t in docs], DOC), spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)).collect()
    assert {(r.doc_id, r.item_id, r.n_matched) for r in got if r.coverage >= d.COVERAGE} == brute(docs, items)


def test_a_broken_variant_does_not_hide_a_later_copy(spark):
    item = "Tom has five apples and buys five pears at the market."
    broken = "Tom has six apples and buys nine pears at the market."
    noise = "These words stand between the questions of the sheet."
    filled = "Tom has four apples and buys four pears at the market."
    docs = [(1, f"{broken} {noise} {item}"), (2, f"{broken} {noise} {broken}"), (3, f"{broken} {noise} {filled}"), (4, f"{filled} {noise} {item}"), (1, f"{broken} {noise} {item}")]
    frame = spark.createDataFrame([(i, t, "h") for i, t in docs], DOC)
    items = spark.createDataFrame([(10, item, 1)], ITEM)
    got = sorted((r.doc_id, r.item_id, r.exact) for r in d.contaminated(frame, items).collect())
    assert got == [(1, 10, True), (3, 10, False), (4, 10, True)]
    # A window that the item itself repeats meets the document at each of its places.
    question = "Tom has {} apples and buys {} pears at the market near the old mill by the river."
    twice = question.format("five", "five") + " " + question.format("two", "seven")
    rows = spark.createDataFrame([(1, question.format("four", "nine"), "h")], DOC)
    assert [r.doc_id for r in d.contaminated(rows, spark.createDataFrame([(11, twice, 1)], ITEM)).collect()] == [1]


def test_windows_of_slots_count_by_value(spark):
    numbers = "On paper add 10 20 30 40 50 60 70 80 90 11"
    long = "Now take 1 from 21 and 2 from 32 3 4 then 5 6 7 8 9 to 10 11 12 13 with 14 15 16 17 or 18 19 20 on 22 23"
    other = "Now take 51 from 71 and 52 from 82 53 54 then 55 56 57 58 59 to 60 61 62 63 with 64 65 66 67 or 68 69 70 on 72 73"
    items = [(1, "Compute 12 + 34 + 56 - 78"), (2, numbers), (3, long), (4, "1 2 3 4 5 6 7 8 9")]
    docs = [
        (1, "We say: compute 12 + 34 + 56 - 78 and more"),
        (2, "We say: compute 12 + 34 + 56 - 79 and more"),
        (3, "Here on paper add 10 20 30 40 50 60 70 80 90 11 and more"),
        (4, "A table 5 6 1 7 8 5 3 1 2 9 8 7 6 5 4 and 3 4 5 1 2 3 8 9 7 5 4 3 2 and more"),
        (5, "They now take 51 from 71 " + other[len("Now take 51 from 71 ") :]),
        (6, "In a row 1 2 3 4 5 6 7 8 9 and more"),
    ]
    frame = spark.createDataFrame([(i, t, "h") for i, t in docs], DOC)
    got = d.contaminated(frame, spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in got} == {(1, 1, True), (3, 2, True), (5, 3, False), (6, 4, True)}


def test_names_in_small_letters(spark):
    docs = spark.createDataFrame([(1, QUESTION.lower(), "h"), (2, "He said: " + QUESTION.lower().replace("12", "14"), "h"), (3, OTHER.lower(), "h")], DOC)
    items = spark.createDataFrame([(10, QUESTION, 1), (11, "Too short", 1), (12, None, 1)], ITEM)
    assert {(r.doc_id, r.item_id, r.exact) for r in d.contaminated(docs, items).collect()} == {(1, 10, True), (2, 10, False)}
    assert sorted(r.item_id for r in d.unmatchable(items).collect()) == [11, 12]


def plain_template(text, names):
    """Words, one-digit numbers and one-word names; a sentence ends at a full stop."""
    out, opening = [], True
    for word in text.replace(".", " . ").split():
        if word == ".":
            opening = True
            continue
        if word.isdigit():
            out.append(("#", word))
        elif names and word[0].isupper() and not opening:
            out.append(("@", word.lower()))
        else:
            out.append((word.lower(), None))
        opening = False
    return out


def plain_contaminated(doc, item):
    """Whether a document holds an item, over all pairs of places."""
    seen = plain_template(doc, True)
    for names in (True, False):
        want = plain_template(item, names)
        size = min(8, len(want))
        if size < 4:
            continue
        cut = lambda t: [t[i : i + size] for i in range(len(t) - size + 1)]
        kind = lambda w: (tuple(k for k, _ in w), tuple(v for _, v in w) if all(v for _, v in w) else ())
        firm = lambda w: 2 * sum(v is None for _, v in w) >= size
        lines = {}
        for i, w in enumerate(cut(want)):
            for j, x in enumerate(cut(seen)):
                if kind(w) == kind(x):
                    lines.setdefault(j - i, []).append((w, x))
        counted, run = set(), 0
        for pairs in lines.values():
            consistent = lambda ps: all(len({b for w, x in ps for (_, a), (_, b) in zip(w, x, strict=True) if a == v}) == 1 for w, _ in ps for _, v in w if v)
            strong = [p for p in pairs if firm(p[0])]
            if consistent(strong):
                counted |= {kind(w) for w, _ in strong}
                run = max(run, len(strong))
            if consistent(pairs):
                run = max(run, len(pairs))
            counted |= {kind(w) for w, x in pairs if not firm(w) and (w == x or (consistent(pairs) and len(pairs) >= 13))}
        windows = cut(want)
        every, solid = {kind(w) for w in windows}, {kind(w) for w in windows if firm(w)}
        if len(counted) >= 0.5 * len(every) or (solid and len(counted & solid) >= 0.5 * len(solid)) or run >= 13:
            return True
    return False


def test_slots_names_and_consistency_against_brute_force(spark):
    """Texts over few words, digits and names, with re-parameterised, broken and cut copies of items."""
    rnd = random.Random(17)
    word = lambda: rnd.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"])
    name = lambda: rnd.choice(["Xa", "Xb", "Xc"])
    digit = lambda: rnd.choice("1234567")

    def sentence():
        out = [word()]
        for _ in range(rnd.randrange(2, 22)):
            last = out[-1]
            pick = rnd.random()
            out.append(digit() if pick < 0.25 else name() if pick < 0.4 and not last.startswith("X") else word())
        return out

    items = [sentence() for _ in range(40)]
    docs = []
    for _ in range(250):
        words = sentence()
        for _ in range(rnd.randrange(1, 3)):
            copy = list(rnd.choice(items))
            if rnd.random() < 0.5:
                to = {w: digit() if w.isdigit() else name() for w in copy if w.isdigit() or w.startswith("X")}
                copy = [to.get(w, w) for w in copy]
            if rnd.random() < 0.3:
                copy = [digit() if w.isdigit() else w for w in copy]
            if rnd.random() < 0.3:
                copy = copy[rnd.randrange(len(copy)) :] or copy
            if rnd.random() < 0.2:
                copy = [w.lower() for w in copy]
            words += [".", *copy, "."]
        docs.append(" ".join(words))
    got = d.contaminated(
        spark.createDataFrame([(i, t, "") for i, t in enumerate(docs)], DOC), spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(items)], ITEM)
    ).collect()
    texts = [" ".join(t) for t in items]
    first = {t: texts.index(t) for t in texts}
    want = {(i, first[t]) for i, doc in enumerate(docs) for t in first if plain_contaminated(doc, t)}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 100
