"""From raw documents to tokenised training documents.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns
the columns of documents (the last one: token digests a row). run() writes every
stage's result as Parquet into the shared folder and reads it back; a stage's table goes when the next one is written.

Defined results: an empty table stays empty through all stages; further columns are carried
along; rows that repeat an id are copies, of which near-duplicate removal keeps one; rows without an id
are left as they are by that stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import byte_bpe, jaccard_join, language_id, quality_rules, source_mix
from kinloom.llm._store import discard, materialize
from kinloom.runtime import settle, ship

_OWN = "_kinloom_verdict"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without letters or with an unsure label go."""
    ship(spark)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = docs.withColumn(_OWN, language_id.predict_column(F.col("text"), model))
    sure = (F.col(f"{_OWN}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{_OWN}.score") >= language_id.REJECT)
    return judged.where(sure).select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; n_chars, where there is one, tells the length of what is left."""
    ship(spark)
    judged = docs.withColumn(_OWN, quality_rules.quality_and_text(F.col("text")))
    cleaned = judged.where(quality_rules.kept(F.col(_OWN))).withColumn("text", F.col(f"{_OWN}.cleaned"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links: the one with the smallest id."""
    settle(ship(spark))
    groups = jaccard_join.jaccard_components(docs)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(_OWN)).distinct()
    kept = docs.join(keep, F.col("doc_id") == F.col(_OWN), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated or left out so that sources meet their target weights."""
    settle(spark)
    return source_mix.mix_sources(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mixture."""
    import public_tokenizers

    settle(ship(spark))
    return byte_bpe.tokenize(docs, byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", filter_quality),
    ("jaccard_join", drop_near_duplicates),
    ("source_mix", mix),
    ("byte_bpe", tokenize),
]

#: The first and last stages are not expressible in SQL; tests/llm checks the stages between them, and the tokens' round trip, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
