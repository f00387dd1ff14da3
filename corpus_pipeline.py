"""Five corpus operators in a row, from raw documents to token ids.

Every stage takes rows with null ids or texts, empty and very long texts, repeated rows, further columns
(but for names that start with ``_tm_``) and an empty table; all but the last return the columns they got. Null
and empty texts are never toxic, hold no line that goes and no benchmark item, are near copies of each
other, and have no tokens. Rows equal in id and text are one document from the near-duplicate stage on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, near, toxicity
from tidemark.llm.common import stored
from tidemark.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Without labels of both classes none is."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, column="_tm_toxicity").where("_tm_toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents that consist of nothing else."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    sized = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", sized).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return near.keep_one(docs, similarity=0.8, shingle_words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining document, and the digest of what they decode to."""
    out = bpe.encode(docs, tokenizer_path(), decode=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: A trained model and a tokenizer are no SQL.
ORACLE_SQL: str | None = None
