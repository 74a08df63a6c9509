"""Documents from raw to mixed, as stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.decontamination import decontaminate
from spanlake.llm.frames import drop, scratch
from spanlake.llm.jaccard_join import one_of_each_group
from spanlake.llm.line_dedup import line_dedup
from spanlake.llm.mixing import Mixture
from spanlake.llm.quality import score, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 2, trained on the labels, doesn't reject; all of them where no label could be trained on."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not machine.fitted:
        return docs
    return score(docs, machine).where("predicted = 1").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without repeated three-line windows; n_chars follows the text."""
    return line_dedup(docs).select(docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles link at a similarity of 0.8."""
    return one_of_each_group(docs, percent=80, width=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of any benchmark item's five-word shingles."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of words mixed from the sources by weight: a row for each document's part of each slot of an output shard."""
    return Mixture(docs).blocks(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("jaccard_join", near_copies), ("decontamination", benchmark), ("mixing", mix)]

#: A trained classifier decides the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each keeps is a Parquet table in the shared checkpoint folder, until the next one's is whole."""
    root = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            drop(spark, f"{root}/{before}")
        before = name
    return docs
