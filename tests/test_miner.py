"""Sources, the engine, streaming, and accuracy end to end."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.align import covers
from millrace.operators import evaluate as ev
from millrace.operators.groundtruth import build_groundtruth
from millrace.operators.match import CoverIndex, cover_pairs
from millrace.operators.relational import dense_line_id, neighbourhood, roots
from millrace.operators.sampling import farthest_points, hard_negatives, hard_positives, pairs_near, synth_positive
from millrace.plans.engine import Miner, outputs
from millrace.plans.providers import Callback, Lookup, Provider
from millrace.sources import readers, sinks
from millrace.streaming.online import OnlineMiner, log_stream, windowed_counts

TEMPLATES = ["open connection <*> to port <*>", "closed session of user <*>", "disk <*> is full", "retry <*> of <*> failed", "started"]


def corpus(n):
    out = []
    for i in range(n):
        t = TEMPLATES[i * 7 % len(TEMPLATES)]
        out.append((i + 1, re.sub(r"<\*>", lambda _: f"v{i}x{i % 3}", t), t))
    return out


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "LineId long, Content string, EventTemplate string")


def test_load_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("[10.30 16:49:06] chrome.exe - open\n  broken line\n[10.30 16:49:07] x - close, 5 bytes  \n", encoding="utf-8")
    got = readers.load_log(spark, str(tmp_path / "a.log"), "Proxifier").orderBy("LineId").collect()
    assert [tuple(r) for r in got] == [(1, "10.30 16:49:06", "chrome.exe", "open"), (2, "10.30 16:49:07", "x", "close, 5 bytes")]
    assert readers.load_sample(spark, str(tmp_path / "a.log"), "<Content>", 2).count() == 2


def test_csv_and_json_round_trips(spark, tmp_path):
    rows = [(0, 'say "hi", <*>', 3), (1, "two\nlines", 1)]
    frame = spark.createDataFrame(rows, "EventId int, EventTemplate string, Occurrences long")
    sinks.write_templates(frame, str(tmp_path / "t"))
    back = readers.load_templates(spark, str(tmp_path / "t")).orderBy("EventId").collect()
    assert [(int(r.EventId), r.EventTemplate, r.Occurrences) for r in back] == rows
    (tmp_path / "e.json").write_text(json.dumps([{"content": "a 1", "template": "a <*>"}, {"content": "b", "template": "b"}], indent=4))
    examples = readers.load_examples(spark, str(tmp_path / "e.json")).orderBy("id").collect()
    assert [(r.id, r.content, r.Postive_Example) for r in examples] == [(0, "a 1", None), (1, "b", None)]
    sinks.write_examples(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_dense_line_id(spark):
    frame = spark.range(0, 1000, 3).repartition(7).select(F.col("id").alias("k"))
    got = dense_line_id(frame, ["k"]).orderBy("LineId").collect()
    assert [r.LineId for r in got] == list(range(1, 335)) and [r.k for r in got] == list(range(0, 1000, 3))


def test_dense_line_id_over_many_partitions(spark):
    """Wide shuffled rows in many small partitions, which adaptive planning puts together as it likes."""
    n, name = 300_000, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        rows = spark.range(n).select((F.col("id") * 7 % n).alias("k"), F.lit("y").alias("y"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 5).alias("wide")).repartition(9)
        got = dense_line_id(rows, ["k"])
        found = got.agg(F.count("*"), F.countDistinct("LineId"), F.min("LineId"), F.max("LineId"), F.count_if(F.col("LineId") != F.col("k") + 1)).first()
    finally:
        spark.conf.set(name, before)
    assert tuple(found) == (n, n, 1, n, 0)
    assert got.columns == ["LineId", "k", "y", "wide"]
    assert dense_line_id(rows.limit(0), ["k"]).count() == 0


def test_load_log_over_many_splits(spark, tmp_path):
    """Lines are numbered in file order where files are read in many splits and lines are left out."""
    for f in range(3):
        text = "".join(f"[t] app - file {f} line {i}\n" if i % 5 else "broken\n" for i in range(4000 * (3 - f)))
        (tmp_path / f"{f}.log").write_text(text)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20k")
    try:
        got = [(r.LineId, r.Content) for r in readers.load_log(spark, str(tmp_path), "Proxifier").orderBy("LineId").collect()]
        some = [(r.LineId, r.Content) for r in readers.load_sample(spark, str(tmp_path), "Proxifier", 3000).orderBy("LineId").collect()]
    finally:
        spark.conf.set(name, before)
    want = [f"file {f} line {i}" for f in range(3) for i in range(4000 * (3 - f)) if i % 5]
    assert got == list(enumerate(want, 1)) and some == got[:3000]


def test_roots_and_neighbourhood(spark):
    links = spark.createDataFrame([(i, max(0, i - 1)) for i in range(40)], "cid long, next long")
    assert {r.root for r in roots(links).collect()} == {0}
    places = spark.range(30).select("id")
    got = {(r.id, r.n_id) for r in neighbourhood(places, places, "id", 4).collect()}
    assert got == {(a, b) for a in range(30) for b in range(30) if a != b and abs(a - b) <= 4}


def test_mining_with_recorded_answers_is_exact(spark):
    rows = corpus(60)
    lines = lines_of(spark, rows)
    provider = Lookup({c: t for _, c, t in rows})
    mined = Miner(provider).mine(lines.select("LineId", "Content"))
    structured, templates = outputs(mined)
    truth, names = build_groundtruth(lines.select("LineId", "Content"), lines.select("Content", "EventTemplate", F.col("LineId").alias("pos")))
    # One template is a single token and keeps its text.
    score = ev.evaluate(truth, structured, names, templates).first()
    assert score.GA == score.FGA == score.PA == score.FTA == 1.0
    assert sum(r.Occurrences for r in templates.collect()) == 60


def test_rounds_equal_sequence_with_recorded_answers(spark):
    rows = [r for r in corpus(60) if " " in r[1]]
    provider = Lookup({c: t for _, c, t in rows})
    one, two = Miner(provider), Miner(provider)
    cids = one.learn(spark, [c for _, c, _ in rows])
    by_line = {r.LineId: r.EventTemplate for r in two.mine(lines_of(spark, rows).select("LineId", "Content")).collect()}
    assert [one.clusters[c].template for c in cids] == [by_line[i] for i, *_ in rows]
    again = Miner(provider)
    again.restore(one.state())
    assert all(again.find(c) is not None for _, c, _ in rows)


def test_rounds_equal_sequence_on_mixed_messages(spark):
    """Templates of many shapes, near-equal leaders, covered messages, single tokens, blanks and nulls."""
    rnd, rows = random.Random(5), []
    shapes = ["open <*> port <*>", "open <*>", "open file", "user <*> in", "user <*> out", "a=<*>, b=<*>", "start", "", "disk <*> of <*> is <*> full", "disk <*> of <*> is gone"]
    for i in range(150):
        shape = rnd.choice(shapes)
        text = re.sub(r"<\*>", lambda _: rnd.choice(["x1", "yy", "7", "a-b", "c:d"]), shape)
        rows.append((i + 1, text, shape))
    provider = Lookup({c: t for _, c, t in rows})
    one, two = Miner(provider), Miner(provider)
    spaced = [(i, c) for i, c, _ in rows if " " in c]
    cids = one.learn(spark, [c for _, c in spaced])
    lines = spark.createDataFrame([(i, c) for i, c, _ in rows] + [(1000, None), (1001, "  ")], "LineId long, Content string")
    mined = {r.LineId: r for r in two.mine(lines).collect()}
    assert len(mined) == 152
    assert {i: one.clusters[c].template for (i, _), c in zip(spaced, cids, strict=True)} == {i: mined[i].EventTemplate for i, _ in spaced}
    assert all(mined[i].cid is None and mined[i].EventTemplate == "" for i in (1000, 1001))
    assert two.observed.get["lines"] == 152 and two.observed.get["unmatched"] == 0


def test_near_equal_messages_wait_for_the_first(spark):
    """One of the alike is asked for; the others are found by its template in the next round."""
    rows = [(i, f"connection of host {w} was closed by peer") for i, w in enumerate(("red", "blue", "green", "white"))]
    known = "connection of host <*> was closed by peer"
    miner = Miner(Lookup({t: known for _, t in rows}))
    mined = miner.mine(spark.createDataFrame(rows, "LineId long, Content string")).collect()
    assert {r.EventTemplate for r in mined} == {known} and miner.asked == 1


def test_merges_keep_the_template_unless_told(spark):
    class Same(Lookup):
        def same(self, message, template, prompt=None):
            return True

    messages = ["job red is done now", "job blue is done now", "job green is done now"]
    for generalise, want in ((False, "job red is done now"), (True, "job <*> is done now")):
        miner = Miner(Same({m: m for m in messages}), generalise=generalise)
        assert set(miner.learn(spark, messages)) == {0} and [c.template for c in miner.live()] == [want]
        again = Miner(Same())
        again.restore(miner.state())
        assert again.find("job pink is done now") == 0 and again.state() == miner.state()


def test_absorbed_clusters_still_match(spark):
    miner = Miner(Lookup({"user a in": "user a in", "user b in": "user <*> in"}), threshold=2.0)
    assert miner.learn(spark, ["user a in", "user b in"]) == [1, 1]
    assert miner.root(0) == 1 and miner.find("user a in") == miner.find("user c in") == 1


def test_cover_candidates_against_brute_force(spark):
    rnd = random.Random(6)
    token = lambda: rnd.choice(["a", "b", "<*>", "x=<*>", "x=1", "x=2", "c", "", "<*>:<*>", "1:<*>"])
    texts = sorted({" ".join(token() for _ in range(rnd.choice([1, 2, 3]))) for _ in range(150)})
    want = {(i, j) for j in range(len(texts)) for i in range(j) if covers(texts[i], texts[j])}
    frame = spark.createDataFrame(list(enumerate(texts)), "tid long, template string")
    got = [(r.a, r.b) for r in cover_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    index = CoverIndex()
    for k, text in enumerate(texts):
        index.put(k, text)
    for i, j in want:
        assert i in index.candidates(texts[j]) and j in index.candidates(texts[i])


def test_failing_and_tagged_providers(spark):
    class Broken(Provider):
        def template(self, message, prompt=None):
            raise OSError("down")

    lines = lines_of(spark, corpus(10)).select("LineId", "Content")
    assert {r.cid is None or r.EventTemplate for r in Miner(Broken()).mine(lines).collect()}
    prompts = []

    def answer(prompt):
        prompts.append(prompt)
        if "Answer:" in prompt.splitlines()[-1]:
            return "<START>No<END>"
        return "<START>" + re.sub(r"v\w+", "<*>", prompt.rsplit("<START>", 1)[1].split("<END>")[0]) + "<END>"

    shown = [{"content": "disk a1 is full", "template": "disk <*> is full", "positive": "disk b is full", "negative": "x"}, {"content": "other 1", "template": "other <*>"}]
    found = {r.EventTemplate for r in Miner(Callback(answer), examples=shown, k=1).mine(lines).collect()}
    assert any("<START>disk a1 is full<END>\nTemplate:\n<START>disk <*> is full<END>" in p for p in prompts)
    assert "disk <*> is full" in found and Miner().mine(lines.limit(0)).count() == 0


def test_streaming_equals_one_batch(spark, tmp_path):
    rows = corpus(50)
    provider = Lookup({c: t for _, c, t in rows})
    folder = tmp_path / "in"
    for k in range(5):
        lines_of(spark, rows[k * 10 : k * 10 + 10]).select("LineId", "Content").coalesce(1).write.parquet(str(folder / f"b{k}"))
    stream = spark.readStream.schema("LineId long, Content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    online = OnlineMiner(str(tmp_path / "out"), lambda: Miner(provider))
    online.start(stream).awaitTermination()
    got = {r.LineId: r.EventTemplate for r in online.lines(spark).collect()}
    whole = {r.LineId: r.EventTemplate for r in Miner(provider).mine(lines_of(spark, rows).select("LineId", "Content")).collect()}
    assert got == whole
    before = online.lines(spark).count()
    online.process(spark.read.parquet(str(folder / "b4")), 4)  # a replayed batch changes nothing
    assert online.lines(spark).count() == before


def test_stream_of_log_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.log").write_text("".join(f"[t] app - open x{i} file {k}\n" for i in range(5)))
    online = OnlineMiner(str(tmp_path / "out"))
    online.start(log_stream(spark, str(tmp_path / "in"), "Proxifier", max_files=1)).awaitTermination()
    got = online.lines(spark).collect()
    assert sorted(r.LineId for r in got) == list(range(1, 21)) and len({r.EventTemplate for r in got}) == 1
    versions = sorted(p.name for p in (tmp_path / "out/state").iterdir())
    assert versions == ["batch=2", "batch=3"]
    # A version that cannot be read is an error, and does not start from nothing.
    for part in (tmp_path / "out/state/batch=3").glob("part-*"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        online.process(spark.createDataFrame([(99, "open x file")], "LineId long, Content string"), 4)


def test_windowed_counts_on_a_stream(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as ts, concat('t', id % 2) as EventTemplate from range(48)")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))


def test_accuracy_of_splits_merges_and_nulls(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "LineId long, EventId string")
    same = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z")], "LineId long, EventId string")
    names = lambda *n: spark.createDataFrame([(x, f"t <*> {x}") for x in n], "EventId string, EventTemplate string")
    score = ev.evaluate(truth, same, names("a", "b", "c"), names("x", "y"))
    row = score.first()
    assert (row.GA, row.PGA, row.RGA) == (0.5, 0.5, 1 / 3) and row.PA == 0
    wrong = spark.createDataFrame([(i, "w") for i in range(1, 5)], "LineId long, EventId string")
    row = ev.evaluate(truth, wrong, names("a", "b", "c"), names("w")).first()
    assert row.FGA == row.FTA == 0.0
    pair = spark.createDataFrame([("p", "a", 2)], "p string, t string, n long")
    listed = ev.equal_templates(pair, spark.createDataFrame([("a", "PSU status (<*> <*>)")], "EventId string, EventTemplate string"), spark.createDataFrame([("p", "PSU status ( <*> <*> )")], "EventId string, EventTemplate string"))
    assert listed.count() == 1


def test_sampling(spark):
    texts = spark.createDataFrame([(0, "aaaa"), (1, "aaab"), (2, "zzzzzzzz"), (3, "aaaa")], "id long, text string")
    assert farthest_points(texts, 4) == [0, 2, 1]
    lines = spark.createDataFrame([(0, "a 1", "a <*>"), (1, "a 22222", "a <*>"), (2, "b 1", "b <*>"), (3, "c c c", "c c c")], "id long, text string, template string")
    pairs = pairs_near(lines, lines, reach=2, extra=2)
    assert {r.id: r.n_id for r in hard_positives(pairs).collect()} == {0: 1, 1: 0}
    assert {r.id: r.n_id for r in hard_negatives(pairs).collect()}[0] == 2
    made = synth_positive("a <*> b", "a 12x b", 5)
    assert made == synth_positive("a <*> b", "a 12x b", 5) != "a 12x b" and re.fullmatch(r"a \d\dx b", made)


def test_examples_and_command_line(spark, tmp_path, capsys):
    from millrace import cli
    from millrace.plans.examples import choose, with_contrasts

    truth = lines_of(spark, corpus(200))
    chosen = choose(truth, 6, rate=0.5)
    found = with_contrasts(chosen, truth, rate=0.5).collect()
    assert len(found) == 6 and all(r.Postive_Example and r.Negative_Example for r in found)
    log = tmp_path / "x.log"
    log.write_text("".join(f"[1.1 1:00] app - {c}\n" for _, c, _ in corpus(40)))
    notes = spark.createDataFrame([(c, t) for _, c, t in corpus(40)], "Content string, EventTemplate string")
    sinks.write_csv(notes, str(tmp_path / "notes"))
    cli.main(["parse", str(log), "Proxifier", str(tmp_path / "p")])
    cli.main(["groundtruth", str(log), "Proxifier", str(tmp_path / "notes"), str(tmp_path / "g")])
    cli.main(["evaluate", str(tmp_path / "g/structured"), str(tmp_path / "p/structured"), str(tmp_path / "g/templates"), str(tmp_path / "p/templates")])
    assert "GA" in capsys.readouterr().out


def test_many_alike_become_one_template(spark):
    messages = [f"job {w} is done now" for w in ("red", "blue", "green", "black", "white", "pink", "grey")]
    one = Miner(Lookup({m: m for m in messages}), threshold=2.0, generalise_many=True)
    one.learn(spark, messages)
    assert [c.template for c in one.live()] != messages
    assert "job <*> is done now" in {c.template for c in one.live()} and len(one.live()) < len(messages)
    plain = Miner(Lookup({m: m for m in messages}), threshold=2.0)
    plain.learn(spark, messages)
    assert [c.template for c in plain.live()] == messages
