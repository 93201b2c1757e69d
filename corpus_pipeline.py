"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage sees every row that the one
before it kept, read back from Parquet.

Defined results: as the operators state them; an empty documents table passes
through all stages and gives no pieces. Null texts fail the rules. Further
columns are carried by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import minhash_dedup, nbsvm, packing, pii, quality_rules
from millrace.llm.common import written
from millrace.llm.queries import vocabulary


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of policy v1."""
    return quality_rules.keep_good(docs, quality_rules.POLICIES["v1"])


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below a half.

    The model is fitted on labelled rows of the raw table: the rules before this
    stage leave too few examples of bad documents.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = nbsvm.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nbsvm.keep_good(docs, model, 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles at 0.8 or more."""
    return minhash_dedup.keep_one(docs, size=5, threshold=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and tokenizers decide; SQL can't express that.
ORACLE_SQL = None
