"""From raw documents to packed training sequences.

Each stage takes what the one before kept, as written Parquet. The first four
return documents, the last one the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.fingerprints import without_copies
from papertally.llm.jaccard import without_similar
from papertally.llm.mixing import mix
from papertally.llm.packing import pack
from papertally.llm.toxicity import without_toxic
from papertally.session import shared_path

#: A name weighs as its tokens to this power: small languages and sources gain.
TEMPER = 0.85


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples mark as toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest doc_id stays."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 on five-word shingles connect, one stays."""
    return without_similar(docs, words_each=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages, and sources within them, by tempered weight. The budget lets
    every document in once; names with more weight than tokens repeat documents
    in further epochs."""
    tempered = F.floor(F.pow("tokens", F.lit(TEMPER)))
    return mix(docs, ["lang", "source"], [tempered, tempered], max_epochs=3).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens with little padding."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: Token ids and nearest examples cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
