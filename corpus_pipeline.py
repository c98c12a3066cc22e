"""From raw documents to token ids, in five stages; each is written as Parquet before the next one reads it.

1. quality: documents that fail a base rule, or whose host fails as a whole, go.
2. line dedup: lines that other documents hold too stay in the smallest doc_id; n_chars follows the text.
3. near dedup: one document of each group stays (the smallest doc_id); groups are linked where SimHash fingerprints of
   five-word shingles say that the cosine is 0.8 or more, which takes in a Jaccard of 0.8.
4. mixing: documents are sampled so that sources, languages and topics come nearer to equal weights.
5. tokens: ids of every whole text, with a check that they decode to it.

Null texts, ids and sources, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; the first four stages keep all columns that they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, line_dedup, mixing, quality, simhash
from skein.llm.common import new_path, read_table

#: The share of the tokens that mixing keeps.
BUDGET = 0.8
#: The cosine of two texts' sets of five-word shingles from which near dedup links them.
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))
    return left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, simhash.Prints.similar(SIMILARITY))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, BUDGET)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", same.alias("decodes"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("near dedup", near_dedup), ("mixing", mix), ("tokens", tokenize)]

#: SQL can neither hash with XXH64 nor merge by rank; the tests run every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
