"""A corpus from documents: quality, near duplicates, secrets, mixture, packed sequences.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written as Parquet and read again as the next
stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import drop_materialized, free_prefix, materialize, read_table
from helixframe.llm.jaccard import jaccard_components
from helixframe.llm.mixing import mix_sources
from helixframe.llm.packing import pack_documents
from helixframe.llm.quality import score_quality, train_quality
from helixframe.llm.queries import QUALITY_CUT, held_out
from helixframe.llm.secrets import redact_secrets, train_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the model's prior as their score, and go or stay by it; repeated rows and ties of one score
    share their fate. Rows without doc_id are scored like others, but no label speaks of them. An own column ``score``
    stays as it is. An empty table stays empty.
    """
    score = f"{free_prefix(docs.columns)}score"
    model = train_quality(docs, read_table(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, model, score).filter(F.col(score) >= QUALITY_CUT).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of shingle sets join, one row stays: that of the smallest id, null ones last.

    Rows are written with a number of their own instead of doc_id, so null and repeated ids are rows like others, of any
    columns; of equal ids the row with the least digest of its text stays. Null and blank texts are in no group.
    """
    row = f"{free_prefix(docs.columns)}row"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    least = groups.join(ids, row).groupBy("component_id").agg(F.min(F.struct(F.isnull("id"), "id", "digest", row)).alias("x"))
    return rows.join(least.select(f"x.{row}"), row, "left_semi").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes. Null and empty texts, ids and other columns: see ``redact_secrets``."""
    return redact_secrets(docs, train_secrets(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that bring sources, languages and topics to their target shares.

    Null and empty texts stay; equal rows stay or go together; a null source is a source of its own.
    """
    return mix_sources(docs).filter(F.col(f"{free_prefix(docs.columns)}kept")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 1024 tokens; null and empty texts are one token."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No stage's model or packing can be stated in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    read = None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = materialize(made, f"stage{k}")
            if read is not None:  # the next stage reads this one's rows alone
                drop_materialized(read)
            read = made
        docs = made
    return docs
