"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again for the next.

Defined cases: texts that are null or empty pass the first three stages and
end at mixing, which takes words alone; null languages and sources are ones of
their own; rows without an id stay. A row that is there several times, with id
and text alike, stays once. Columns beyond those of ``documents`` pass all
stages but the last, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import read
from fieldloom.llm.minhash import near_duplicates
from fieldloom.llm.mixing import mixed_documents
from fieldloom.llm.packing import pack
from fieldloom.llm.quality import fit, kept_documents
from fieldloom.llm.secrets import redact
from fieldloom.plans.storage import release, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    classifier, scored = fit(docs, read(spark, sf_dir, "labels"))
    return kept_documents(docs, classifier.decide(scored))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id, once. Rows without an id stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    named = named.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return named.unionByName(docs.where("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with findings replaced by their kinds."""
    out = docs.withColumn("text", redact(F.col("text")))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or their parts, that the mix of sources takes, as often as it does."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in bins of the permitted lengths."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the model nor the matching.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
