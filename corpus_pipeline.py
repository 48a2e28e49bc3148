"""Documents to training tokens in five stages; each works on all that the one before kept.

STAGES: (name, function(spark, docs, sf_dir) -> DataFrame). All but the last return the columns
of documents; the last returns doc_id, n_tokens, digests of the ids and of the decoded bytes, and
the row's position in the mixed order, which is read from the files that the stage before wrote.

Defined cases, in every stage: null texts count as empty where a stage reads them, and stay null
where it doesn't change them; null ids are kept (of near copies one row stays, null ids last);
rows that repeat an id and a text are copies of each other; null langs, sources and counts are
values like others; columns beyond those of documents are dropped; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import bpe, common, minhash, mixing, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels it rejects none."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, common.read(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; those without words all stay."""
    return minhash.keep_first(docs.select(*COLUMNS))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced; n_chars follows the new text (null for a null text)."""
    out = pii.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves their sources by target weight; a null source is one too."""
    return mixing.mixed(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, with its position in the order of the files (null if there are none)."""
    return bpe.round_trip(mixing.places(docs.select(*COLUMNS)), *bpe.public_vocabulary(), carry="position")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_distinct),
    ("pii", redact_personal),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Learnt scores, boosted trees and merges are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet to the shared folder and reread.

    A stage's files are removed once the next stage's are written; the last ones stay, as the result reads them.
    """
    common.checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
        if before:
            common.remove(spark, before)
        before = f"{shared}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
