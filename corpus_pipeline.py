"""A corpus pipeline of five stages, each one operator applied to all that the stage before kept.

Toxic documents go, one document of each group of near-copies stays, personal data becomes
surrogates, sources are mixed to their target weights, and the result is encoded. All stages but the
last return the columns of ``documents``. Every stage takes null, empty and very long texts, null and
repeated ids, repeated rows, further columns and empty tables as its operator's docstring says; exactly
repeated rows and copies leave one row at the second stage. A stage's rows are removed when the next
stage's are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from propgraph.llm import bpe, mixing, pii, simhash, toxicity
from propgraph.llm.common import read, shared_folder
from propgraph.llm.queries import RANKS, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that score 0.5 or more go."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of linked fingerprints the document of least id stays."""
    return simhash.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: entities become surrogates; n_chars stays what the source gave."""
    return pii.replace(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: token ids with their byte offsets, and whether they decode to the text."""
    return bpe.encode(docs, tokenizer_path(RANKS), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No stage but the fourth can be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
