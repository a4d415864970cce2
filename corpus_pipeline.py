"""From raw documents to packed training sequences, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's
documents.  All but the last return the columns of the documents table.

Nulls and awkward rows: a null or empty text has no language and goes in the first stage, as does a text without a letter; a
null in lang, source or n_chars is kept; a row without a doc_id is no holder of lines and no near duplicate of any other, and stays
where its text may.  Repeated rows are scored each, their lines go or stay together, and one of them is left by the near-duplicate
stage.  Empty tables and an empty benchmark give empty or unchanged tables.  Columns beyond COLUMNS are not carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.op1_line_dedup import dedup_lines
from lectern.llm.op4_decontamination import without_contaminated
from lectern.llm.op6_minhash import near_duplicates
from lectern.llm.op8_packing import pack_documents
from lectern.llm.op10_language_id import UNDETERMINED, identify_languages
from lectern.llm.shared import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this probability of its best language a text is rejected as being in none.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or in no language known, go."""
    found = identify_languages(docs, keep=COLUMNS)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that align with an earlier document go; so do documents of which nothing is left."""
    kept = dedup_lines(docs, keep=("lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, and of repeated rows of it one."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained classifier nor the alignments; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
