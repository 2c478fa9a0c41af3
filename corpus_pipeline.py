"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; ``run``
writes each result as Parquet in the shared folder, removes what the stage wrote on the way, and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.llm import language_gru, ngram_join, packing, quality_fm, source_mix

#: A score from which a document stays, and the least language probability.
MIN_QUALITY, MIN_LANGUAGE = 0.3, 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.score(docs, model, "__score").where(F.col("__score") >= MIN_QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: not ``und``, and not below the least probability."""
    named = language_gru.label(docs, language_gru.train(docs), "__lang", "__score")
    return named.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANGUAGE)).select(*docs.columns)


def key() -> Column:
    """What names a document: its id and text together, since ids may be null or repeated."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each class of near copies that has the smallest id (a null is the largest).

    Rows with the same id and the same text are one document, texts without a word included.
    """
    found = ngram_join.ngram_jaccard_join(docs.select(key().alias("doc_id"), "text")).select(F.col("doc_id").alias("__of"), "class_id")
    named = docs.select(key().alias("__key"), "doc_id").distinct().join(found, F.col("__key") == F.col("__of"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__key"))).getField("__key")
    kept = named.groupBy("class_id").agg(first.alias("__of")).select("__of")
    return docs.withColumn("__key", key()).join(kept, F.col("__key") == F.col("__of"), "left_semi").dropDuplicates(["__key"]).drop("__key")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it takes in part is cut to those words.

    No two rows may have both id and text in common, as after the stage before.
    """
    mixed = source_mix.mix(docs.withColumn("doc_id", key())).where("taken > 0").select(F.col("doc_id").alias("__of"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("first_word").cast("int").alias("__first"), F.col("part_words").cast("int").alias("__words"))
    times = (F.col("__taken") / F.col("__size")).cast("int")
    whole = F.array_repeat(F.lit(False), times)
    copies = F.when(F.col("__taken") % F.col("__size") > 0, F.concat(whole, F.array(F.lit(True)))).otherwise(whole)
    rows = docs.join(mixed, key() == F.col("__of")).withColumn("__cut", F.explode(copies))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    part = F.array_join(F.slice(F.concat(words, words), F.col("__first") + 1, F.col("__words")), " ")
    rows = rows.withColumn("text", F.when(F.col("__cut"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in packed sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("mixing to target weights", mixing), ("packing", sequences)]

#: Stages with trained models and similarity joins have no SQL form; tests hold ``run`` to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = runtime.stored(spark, lambda: stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
