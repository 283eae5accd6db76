"""The corpus pipeline: language, near duplicates, repeated passages, mixture, batches.

Each stage takes (spark, docs, sf_dir) and gives the documents that the next one reads, with the columns of documents; the
last one gives the packed rows. run() writes each stage as Parquet under the session's shared checkpoint folder and reads
it again, so a stage that is redone after a lost executor starts from files, not from the whole lineage; once a stage is
written, the files of the one before it go.

Defined cases, of every stage: an empty table gives an empty one; columns of any other name, also those of a stage's own
results, are passed on as they are; repeated rows and null ids are what the operators' docstrings say of them. A document
without a letter (so also a null or empty text) goes in the first stage; of documents alike, the one with the smallest id
stays, and of null ids one a text; a null source is a source of its own; whatever the length of a text, it is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import language_id, mixing, near_dup, packing, suffix_dedup
from tidewright.llm.common import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; it learns from the documents table."""
    return language_id.accepted(docs, sf_dir)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8."""
    return near_dup.keep_one(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that start earlier; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffix_dedup.dedup(docs, keep=("doc_id", *others), with_text=True)
    place = {c: f"_{k}" for k, c in enumerate(["doc_id", *others])} | {"text": f"_{len(found.columns) - 1}"}
    found = found.toDF(*[f"_{k}" for k in range(len(found.columns))])
    if "n_chars" in docs.columns:
        found = found.withColumn(place["n_chars"], F.length(place["text"]).cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(place[c]).alias(c) for c in docs.columns])


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.materialise(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", target_mix),
    ("length_bucket_packing", batches),
]

#: Trained and randomised stages are not for SQL. The tests hold each stage's rows against a plain version; of the network's
#: scores, the mixture's coins and the order inside a bucket they check the rules and take the values as they are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = written
    return docs
