"""Documents made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's documents. All stages but the last return the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billmill.llm import decontaminate, language, mixing, ngram_join, sharding
from billmill.llm.common import staged, table

LEAST_LANGUAGE_SCORE = 0.25
SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is recognised: not `und`, and not below the least score."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.predict(docs, model)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies. Rows without an id
    are in no group and stay."""
    groups = ngram_join.join(docs)
    copies = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no test item."""
    found = decontaminate.matched(docs, table(spark, sf_dir, "benchmark"), near=True)
    return found.filter(F.size("leaks") == 0).select("row.*")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by their fitted rates, so that toxic tokens go and those of the other domains
    stay as near to what they are as no row twice allows. Clearly toxic documents go whatever their rate;
    a null or empty text is drawn by the rate of a text without any known word."""
    labels = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    return mixing.drawn(docs, labels, drop=("toxic",), most=1).filter("copies > 0").select("row.*")


def vector_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document left."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("vector_sharding", vector_sharding),
]

# Language, mixing and packing are fitted; SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
