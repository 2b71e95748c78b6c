"""A training corpus from documents, in five stages; each calls one operator of folium.llm.

A stage gets what the one before kept, decides, and returns the documents that stay, with the columns of documents; the last
returns the index of the token files. Decisions are joined to documents by doc_id: rows of one doc_id share their
fate until the near-duplicate stage leaves one of them. Rows without a doc_id pass the filters and leave at the mixing stage,
which deals by doc_id. Empty input gives empty output at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.contamination import leaks
from folium.llm.mixing import mix_documents
from folium.llm.near_dups import near_duplicates
from folium.llm.quality import quality
from folium.llm.shared import keep, place, table, trim
from folium.llm.token_files import token_output

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids to drop that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: SQL can't express the quality and mixing stages: tests/llm compares their operators with brute force.
ORACLE_SQL = None


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in gone (doc_id)."""
    gone = keep(gone.select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quality(docs, table(spark, sf_dir, "labels")).where("rejected"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trim(spark)
    found = keep(near_duplicates(docs), "near")
    trim(spark)
    out = without(docs, found.where("not kept"))
    n, ids = found.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    return out if n == ids else out.where("doc_id is null").union(out.where("doc_id is not null").dropDuplicates(["doc_id"]))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it."""
    copies = mix_documents(docs).where("copies > 0").select("doc_id", "copies")
    return docs.join(copies, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trim(spark)
    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_dedup", no_near_copies), ("decontamination", no_benchmark), ("mixing", mixed_sources), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := place(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return docs
