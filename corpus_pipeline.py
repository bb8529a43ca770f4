"""Training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Rows without doc_id are judged by their text in the toxicity and decontamination stages like all others, and pass the near-duplicate stage,
which names documents by their ids. Rows that share a doc_id count as one document there, of which one row stays. Further columns pass
through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edittide.llm import decontaminate, mixing, near, toxicity
from edittide.llm.common import free, removed, shared_dir, table
from edittide.llm.queries import CATEGORIES


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain flags as toxic."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    at = free("scores", docs.columns)
    return toxicity.scored(docs, chain, at).filter(~F.col(at)["is_toxic"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group linked at 80 % over five-word shingles."""
    kept = near.near_duplicates(docs, k=5, percent=80).filter("kept").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    n = free("n", docs.columns)
    one = known.withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy(near.content_order("text")))).filter(F.col(n) == 1)
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages that share ten words in a row with a benchmark item, and drops documents that are mostly such."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


#: Sources in turn: heavy early, level, heavy late. Their integrals are 5, 2 and 1.
SCHEDULES = (mixing.ramp(6.0, 4.0), mixing.constant(2.0), mixing.ramp(0.5, 1.5))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training positions and words taken of every document, by the sources' weight schedules."""
    return mixing.mixed(docs, SCHEDULES)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: Classifier, sketches and automaton are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between them is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{i}-{name}")
            docs = spark.read.parquet(f"{at}/{i}-{name}")
            if i:
                removed(spark, f"{at}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
