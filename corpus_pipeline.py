"""Training-corpus pipeline: language ID, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder and rereads
it as the next stage's docs. All but the last return the columns of `documents`. Null ids, texts, languages and sources, empty
tables and extra columns pass through as the operators' docstrings say; an extra column stays until packing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellwise.llm import langid, mixing, packing, secret_scan, simhash
from spellwise.llm.common import read, shared_dir

#: A text is kept if some learnt language explains it this well; texts without a letter never are.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language (`und`, or no language ahead of the others)."""
    columns = docs.columns
    found = langid.identify(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"))
    keep = (F.col("lang_id.lang_pred") != "und") & (F.col("lang_id.score") >= LEAST_SCORE)
    return found.where(keep).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates (four-word shingles, at most four differing bits), the one
    with the smallest id."""
    return simhash.keep_one(docs, radius=4, shingle=4)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask live secrets in the texts."""
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the sources' shares: documents as often as taken, the one at a budget's end with its first words only."""
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the drawn documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: Language models, fingerprints and tokens are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
