"""The corpus pipeline: documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run writes each result as Parquet in the shared scratch
folder and reads it as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import growing, materialise
from starloom.llm.contamination import contaminated
from starloom.llm.copies import near_copies
from starloom.llm.lines import dedup_lines
from starloom.llm.packing import pack_documents
from starloom.llm.quality import held_out, score_quality, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document with a lower score is rejected.
LEAST_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts have a score like others; repeated
    rows fare alike; no rows give none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out("doc_id"))
    machine = train(docs, labels, ["n_chars"])
    return score_quality(docs.select(*COLUMNS), machine, ["n_chars"]).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; what has no line left keeps an empty text. A null text
    stays null; of a repeated row the first keeps its lines; no rows give none."""
    out = dedup_lines(docs.select(*COLUMNS), short=True)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the first row, of copies that a chain of documents of at least
    0.8 Jaccard similarity of five-word shingles connects. Candidates come from SimHashes of whole texts by the
    generalised pigeonhole search, and from a prefix filter on shingles that loses no pair. Rows are told apart by place:
    ids may repeat or be null. Texts without words, null ones too, are copies of each other."""
    numbered = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))
    copies = near_copies(numbered.select(F.col("_row").alias("id"), "text")).where("id <> component").select(F.col("id").alias("_row"))
    return numbered.join(growing(copies), "_row", "left_anti").drop("_row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; no rows give none."""
    numbered = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), "text")
    found = contaminated(numbered.select(F.col("_row").alias("doc"), "text"), items).select(F.col("doc").alias("_row")).distinct()
    return numbered.join(growing(found), "_row", "left_anti").drop("_row")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence, their offset in it and their ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1).drop("piece", "row")


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No stage but the joins is expressible in SQL: a trained model, SimHash and edit distances, a linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
