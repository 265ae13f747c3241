"""From raw documents to packed batches, one operator after the other.

Each stage gets all rows that the one before kept, and its decision takes
effect: the quality classifier and language identification drop what they
reject, the n-gram join keeps one document of each component, mixing brings the
documents into the order of the mix and drops none, and packing gives each its
slot there, its bucket and its batch; batches fill in the order of the mix.

All stages but the last return the columns of the documents, whatever they are
called. Packing adds its own and those of the mix; a column of the documents
with the name of one of these is replaced by it. Empty tables, and tables that
a stage has emptied, give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera._ship import ship
from tessera.llm import langid, mixing, ngram_join, packing, quality
from tessera.llm._runtime import Scratch

#: A document's corrected share of n-grams in its predicted language.
LEAST_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each row that the classifier, learnt from the labels, predicts to be of quality 0.

    Rows are judged by their own text: those that share a doc_id or have none like all others.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    scratch = Scratch(spark, "quality-stage")
    table = scratch.save(quality.features(docs, keep=docs.columns), "features")
    model = quality.fit(table, labels.where(~langid.held_out("doc_id", 5)))
    return quality.apply(table, model).where("predicted = 1").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language, and those that their best language covers too little."""
    ship(spark)
    filters = langid.learn(docs.where(~langid.held_out("doc_id", 5)).select("text", "lang"), Scratch(spark, "language-stage"))
    found = langid.identify(docs.select("text", F.struct(*docs.columns).alias("whole")), filters, ["whole"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("whole.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: five-word shingles, similarity 0.8."""
    ship(spark)
    return ngram_join.deduplicate(docs, k=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix; a source that runs dry leaves the schedule."""
    ship(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the slot in the mix, which follows from the documents themselves, and bucket, batch and place of each."""
    ship(spark)
    return packing.pack(mixing.interleave(docs, added=("mix_slot", "mix_pos")), mixed=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Training, the schedule and the dynamic programme are not SQL; a test compares the rows after each stage with a
#: brute-force version, in which only the quality model's own predictions are taken as they are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
