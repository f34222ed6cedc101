"""The corpus pipeline: five stages over documents, each on all rows that the stage before kept.

Every stage is written as Parquet in the shared folder and read again before the next. All but the last return the columns of
``documents``; toxicity and quality drop the documents they reject, the n-gram join keeps one document of each group, suffix deduplication
cuts repeated passages, packing returns the pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treewarden.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from treewarden.llm.common import map_marked, marks, maybe_marked, table, written

#: No stage can be told in SQL as a whole. tests/llm holds run() against a brute-force version of the last three stages, the verdicts of quality against a plain determinant search, and scores of toxicity against plain loops.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a score of 0.5 or more; trained on the labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.keep_below(docs, model)


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the distance rejects, row by row."""
    return quality.keep_typical(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of similarity 0.8 on five-word shingles. Rows that repeat a doc_id are one document, which stays or goes as a whole; rows without a doc_id stay. Only texts that may go are joined."""
    found = ngram_join.jaccard_components(docs, n=5, percent=80)
    going = written(found.where("component_id != doc_id").select(F.col("doc_id").alias("going")).distinct(), "going")
    bitmap = marks(going, "going")
    near = maybe_marked(docs, bitmap)
    return map_marked(docs, lambda batches: batches, docs.schema, bitmap, False).unionAll(near.join(going, near["doc_id"] == going["going"], "left_anti"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 bytes or more that a document with a smaller doc_id has too."""
    return suffix_dedup.without_repeats(docs, length=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return packing.harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_outliers), ("ngram_join", one_of_each_group), ("suffix_dedup", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
