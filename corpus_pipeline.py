"""A corpus from documents to packed sequences, stage by stage.

Each stage takes the documents that its predecessor kept and returns documents again;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import quality
from trialloom.llm.common import held_out, table, written
from trialloom.llm.mixing import label_domains, mixed_documents
from trialloom.llm.packing import pack
from trialloom.llm.secrets import without_secrets
from trialloom.llm.simhash import deduplicated

#: Shares of tokens to mix to. The first stage rejects low quality on purpose (of the tokens it
#: leaves at sf0.1, a share of 0.000003 is expected to be low), so none is asked for here.
TARGETS = {"clean": 0.9, "toxic": 0.1}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches 0.7 stay."""
    field = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return quality.good_documents(docs, field, least=0.7)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return without_secrets(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: those that are likeliest clean at least once."""
    return mixed_documents(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, keep="clean")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, window=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_to_targets),
    ("packing", packing),
]

#: SQL has no form of a trained field, of connected components or of a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
