"""The corpus pipeline: toxicity, line de-duplication, near-duplicates, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``. Stages are written as Parquet and reread, so that a lost executor costs
the running stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygraph.llm import decontamination, line_dedup, minhash, packing, toxicity
from skygraph.llm.common import Scratch, remainder_of, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7 stay; the field is learned from labelled rows that aren't held out.

    Each row is scored by its own text in one pass, whatever its key: null and empty texts score 0 and stay, rows that repeat a key are
    judged each by itself, further columns are dropped, and an empty table gives an empty one.
    """
    field = toxicity.learn(docs, table(spark, sf_dir, "labels"), remainder_of(F.col("doc_id"), 3) != 1)
    return toxicity.tag(docs.select(*COLUMNS), field, score="_score", spans="_spans").where("_score < 0.7").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 10 words or more are cut out; a document of which nothing is left goes. n_chars is counted anew.

    Null and empty texts stay; a null key comes before all others; rows that agree in key and text are one document and treated alike, so
    their lines aren't each other's copies; further columns are dropped; an empty table gives an empty one.
    """
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), min_words=10, longest_runs=False)
    left = (F.size("removed") == 0) | (F.size("removed") < F.col("n_lines"))
    return found.where(left).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest key stays.

    Rows with a null key and rows of null or empty text stay, as they link with nothing; a key on several rows is one document, and
    its rows stay or go together; further columns are dropped; an empty table gives an empty one.
    """
    return without(docs.select(*COLUMNS), minhash.near_duplicates(docs, threshold=0.8).where("not kept"), ["doc_id"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover half of a benchmark test's words or more go.

    Each row is judged by its own text, whatever its key, null keys included; null and empty texts stay; further columns are
    dropped; an empty table gives an empty one.
    """
    gone = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")), gone, ["doc_id", "text_hash"]).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 2048 tokens.

    Null and empty texts are an end id alone; repeated rows and null keys are packed row by row; further columns are ignored; an
    empty table gives an empty one.
    """
    return packing.pack(docs, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        last, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(last)
    return docs


#: Learned scores, signatures and tokenizers aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
