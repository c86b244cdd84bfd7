"""The corpus pipeline: from raw documents to a mixed, clean training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it again for the next stage. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from vitrine.llm.common import SPACE_CHARS, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go; the scorer is fitted on the labelled documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where("tox_predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more stay in the first one only; a document that consisted of such repeats alone goes."""
    rewritten = line_dedup.drop_repeated_lines(docs, min_docs=10, keep_first=True)
    emptied = (F.col("__n_dropped") > 0) & (F.btrim("__text", F.lit(SPACE_CHARS)) == "")
    kept = rewritten.where(~emptied).withColumns({"text": F.col("__text"), "n_chars": F.length("__text").cast("long")})
    return kept.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the lowest doc_id, of each group of copies and near copies stays."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each copy of a document, with its shard and its order there."""
    return mixing.mixed(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("benchmark decontamination", decontaminate), ("mixing", mix)]

#: The toxicity model and the chosen-path join have no SQL form; tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
