"""From raw documents to token ids: five stages, each over all that its predecessor kept.

A stage is (spark, docs, sf_dir) -> DataFrame; each result is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents. SQL can express none of the learned or encoded stages, so there is
no SQL for the whole; tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, decontaminate, language, minhash, pii, toxicity
from sheaf.llm.queries import digest, table, tokenizer_file
from sheaf.llm.scratch import stash

ORACLE_SQL = None


def _measured_anew(docs: DataFrame) -> DataFrame:
    """docs with n_chars as their texts now are."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit; the model is that of the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~language.in_fold("doc_id", 4, 2))
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), labels)
    return toxicity.kept(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8."""
    return minhash.deduplicated(docs, size=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; in others the passages found are cut out."""
    return _measured_anew(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), mode="both"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms give way to the names of their kinds."""
    return _measured_anew(pii.sanitise(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and a digest of the text decoded from them."""
    done = bpe.encode(docs, tokenizer_file(), decoded="decoded")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", digest(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", sanitise),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
