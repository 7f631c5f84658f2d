"""A document pipeline: toxic documents out, near copies out, benchmark passages out, personal data masked, sources mixed.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept. Stages before
the last return the columns of the documents; the last returns how many words of each
document the mix takes. Rows with a null id are kept by every stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm import apportion, hyperminhash, pii_lstm, toxicity_mil, winnowing
from brinewave.llm.common import stored, table
from brinewave.llm.queries import TOXIC_AT, toxicity_model

#: words in a shingle of the near-copy stage; op6_hyperminhash has two by its contract
SHINGLE = 5


#: the columns of documents; all others travel under names that no operator uses
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def _keeping_others(stage):
    """The stage with foreign columns under private names, so that none can clash with those of the operators."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@_keeping_others
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_mil.score_toxicity(docs, model, docs.columns)
    return scored.where(F.col("score") < TOXIC_AT).select(*docs.columns)


@_keeping_others
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id; of repeated rows, one.

    Rows that share an id but not their text are documents of their own.
    """
    node, keyed = "doc_id", docs
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # seldom
        node = "_node"
        known = F.col("doc_id").isNotNull()
        keyed = docs.withColumn(node, F.when(known, F.struct(F.col("doc_id").alias("id"), F.when(known, F.xxhash64("text")).alias("mark"))))
    found = hyperminhash.near_duplicates(keyed, node, shingle=SHINGLE)
    kept = stored(found.where(f"kept and {node} is not null").groupBy(node).agg(F.count("*").alias("copies")), "kept-documents")
    out = keyed.join(kept.where("copies = 1").select(node), node, "left_semi").unionByName(keyed.where(f"{node} is null"))
    repeated = kept.where("copies > 1").select(node)
    if not repeated.isEmpty():  # another pass over the texts only then
        out = out.unionByName(keyed.join(repeated, node, "left_semi").dropDuplicates([node]))
    return out.select(*docs.columns)


@_keeping_others
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    matched = winnowing.match_benchmark(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return matched.where("n_hit = 0").select(*docs.columns)


@_keeping_others
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew."""
    masked = pii_lstm.redact(docs, pii_lstm.train_tagger(docs))
    if "n_chars" not in docs.columns:
        return masked
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix."""
    return apportion.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("mixing", mixing),
]

#: the stages fit models and draw by seeded hashes, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
