"""From raw documents to token files: five operators in a row.

Each stage reads what the one before it kept. All but the last return the
columns of ``documents``; ``run`` writes every stage to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.llm.decontamination import decontaminate
from debtscope.llm.mixing import mix_documents
from debtscope.llm.quality_rules import clean_lines
from debtscope.llm.queries import tokenizer_config
from debtscope.llm.shared import stored
from debtscope.llm.simhash import drop_near_copies
from debtscope.llm.token_files import read_token_files, write_token_files
from debtscope.session import table, work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; ``n_chars`` follows the text."""
    judged = clean_lines(docs.select(F.struct("*").alias("given"), F.col("text").alias("whole")), "whole")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    row = F.struct(*[new.get(c, F.col(f"given.`{c}`")).alias(c) for c in docs.columns])
    # A filter would be pushed below the measures and take them a second time.
    return judged.select(F.explode(F.when(F.col("kept"), F.array(row))).alias("passed")).select("passed.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at two or fewer differing bits."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, encoded into token files and read back."""
    path = work_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_config())
    return read_token_files(spark, path, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token files", token_files),
]

#: Fingerprints and token ids cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
