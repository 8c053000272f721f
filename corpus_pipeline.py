"""A corpus-cleaning pipeline over ``documents``: quality rules, near-duplicates, repeated passages, packing.

Every stage reads what its predecessor wrote as Parquet in the shared folder.  Null or empty
texts fail the quality rules; rows without an id pass the near-duplicate stage; a document of
which nothing is left after the passage stage goes.  Extra columns of ``documents`` are kept up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.llm import minhash, packing, quality, spans
from imprint.llm.common import fresh, mark, save, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    key, flag = fresh("_gone", docs), fresh("_marked", docs)
    gone = save(minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key)).distinct(),
                "near-copies")
    rows = mark(docs.withColumn(key, F.col("doc_id").cast("long")), gone, [key], flag)
    maybe = rows.where(F.col(flag)).join(gone, key, "left_anti")
    return rows.where(~F.col(flag)).select(*docs.columns).unionByName(maybe.select(*docs.columns))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of later copies of a passage go, and documents made of nothing else."""
    cut = spans.remove_passages(docs)
    removed = F.col(cut.columns[-1])
    cut = cut.where((removed == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as packed token sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup),
          ("pack_sequences", pack_sequences)]
ORACLE_SQL = None  # suffix arrays, tokenizers and packing are beyond SQL; tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
