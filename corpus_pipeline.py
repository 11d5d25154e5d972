"""The corpus pipeline: documents in, token blocks out.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor
kept and returns a frame that ``run`` writes as Parquet and reads again. All but the
last return the columns of ``documents``, whatever more there are.

Defined cases: a null or empty text is never toxic nor contaminated, is one group with all
texts without words, has no tokens to mix and encodes as the end id; a null doc_id is
kept apart by its text; of rows alike in doc_id and text one stays; texts of any length
count whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, mixing, simhash, token_io, toxicity
from millrace.llm.base import discard, load, staged

#: Shares of the corpus: each leaf is read at most once, so this stage selects and never repeats.
MIX = mixing.Plan(share_percent=80, max_epochs=1)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose noisy-or toxicity reaches the threshold."""
    return toxicity.reject_toxic(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: fingerprints that link by BK-trees, and all texts whose five-word shingles are similar by 0.8."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, other numbers and names included."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents to the target weights of ``MIX``."""
    return mixing.mixed(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token blocks and returns what they hold, a row a document."""
    return token_io.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_ids", encode),
]

#: Learned models, fingerprints and a tokenizer are beyond SQL. tests/llm/test_pipeline.py runs the stages over known
#: rows; the other tests there hold each operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
