"""Registered queries of the operators of this subpackage: thin, whole-table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.llm import (bpetrie, domcrf, licenses, merkle, minhash, packing, periodic, pivots, quality, rabitq, radixdup,
                         spans, wavelet)
from imprint.llm.common import table
from imprint.llm.oracle import ORACLE_SQL  # noqa: F401 - the entry takes it from here


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree ``/source/lang/id div 1000/id.txt``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                       F.expr("cast(doc_id div 1000 as string)"), F.expr("concat(doc_id, '.txt')"))
    return licenses.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed(
        "id", "doc_id")


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpetrie.round_trip(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radixdup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domcrf.extract(table(spark, sf_dir, "pages"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the crc32 of the id, the text is folded without its line ends."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.prove(table(spark, sf_dir, "documents"), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods are planted in the documents whose crc32 ends in 0; then runs are found and collapsed."""
    docs = planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse(docs)
    best = F.col("longest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias(
            "runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 of its id, from some word on, goes through the same few words again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr(
        "crc32(cast(doc_id as string)) div 10").alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20).select(
        "query_id", "rank", "vec_id", "score")


QUERIES = {f.__name__: f for f in (op1_licenses, op2_rabitq, op3_bpe_trie, op4_quality, op5_sentence_spans,
                                   op6_radix_dedup, op7_html, op8_wavelet, op9_packing, op10_minhash, op11_merkle,
                                   op12_periodic, op13_pivots)}
