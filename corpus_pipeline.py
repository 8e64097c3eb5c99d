"""A corpus from raw documents: quality rules, near and repeated text, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all that the one before kept, and all but the last return the
columns of documents.  A null doc_id, source or lang passes through; rows that share a doc_id are documents of
their own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm import mixing, near_dup, packing, quality, substring_dup
from chronoweft.llm.queries import TOKENIZER
from chronoweft.llm.store import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now (null: 0)."""
    return rows.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every document, and documents go that fail or lose too much; null and empty texts are among them."""
    judged = quality.clean_lines(docs, carry=("lang", "source")).filter("kept")
    return _documents(judged.withColumn("text", F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id (null last; of equal ones any). Texts without words are in no group and stay."""
    return _documents(near_dup.near_duplicates(docs, k=5, percent=80, carry=("text", "lang", "source")).filter("one"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings are cut out; characters that a cut splits go as well, and documents of which no word is left."""
    left = substring_dup.remove_repeats(docs, substring_dup.Cut(length=100), carry=("lang", "source"), with_text=True)
    return _documents(left.withColumn("text", F.col("left"))).filter((mixing.word_count(F.col("text")) > 0) | (F.col("n_chars") == 0))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mixing.mix_sources(docs, carry=("text", "lang", "source")).filter("times > 0")
    return _documents(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    return packing.pack_documents(docs, TOKENIZER, capacity=1024, end=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mix_sources", mixed_sources),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: MinHash, hashed placement and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
