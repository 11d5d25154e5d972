"""The whole pipeline, stage by stage, over awkward rows."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with a clashing column: clean ones, copies, near copies, toxic ones, benchmark items, nulls, blanks."""
    rnd, path, rows = random.Random(21), str(tmp_path_factory.mktemp("tables")), []
    for i in range(80):
        rows.append((i, words(rnd, 60) + ".", "en" if i % 2 else "de", f"src{i % 4}"))
    toxic = [f"{words(rnd, 8)}. you vile rotten scum are worthless. {words(rnd, 8)}." for _ in range(40)]
    rows += [(100 + i, t, "en", "src1") for i, t in enumerate(toxic)]
    item = words(rnd, 14) + " 12 pears and 30 plums for " + words(rnd, 12)
    rows += [(200, f"{words(rnd, 20)}. {item}. {words(rnd, 20)}", "en", "src2"), (201, rows[0][1], "en", "src2"), (202, rows[1][1] + " more", "en", "src3")]
    rows += [(300, None, "en", "src0"), (301, "", None, "src0"), (None, words(rnd, 30), "en", None), (302, rows[2][1], "fr", "src1"), (302, rows[2][1], "fr", "src1")]
    rows.append((303, words(rnd, 30_000), "es", "other"))
    schema = "doc_id long, text string, lang string, source string, node string"
    spark.createDataFrame([(*r, "clash") for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(100 + i, 0, 1) for i in range(40)] + [(5, 9, 9), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = pipeline.staged(stage(spark, docs, folder), f"test-{name}")
        if name != "token_ids":
            assert docs.columns == columns
        left.append({r.doc_id: r for r in docs.collect()})
    toxic, near, clean, mixed, tokens = left
    ids = lambda low, high: set(range(low, high))
    assert set(toxic) & ids(100, 140) == set() and ids(0, 80) | {200, 201, 202, 300, 301, 302, 303, None} == set(toxic)
    # One of equal and similar texts stays, the least id; the two blank ones are a group, too.
    assert set(near) == set(toxic) - {201, 202, 301, 302}
    assert set(clean) == set(near) - {200}
    assert set(mixed) <= set(clean) and 0.5 * len(clean) <= len(mixed)
    assert set(tokens) == set(mixed) and all(r.n_tokens >= 1 for r in tokens.values())


def test_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
