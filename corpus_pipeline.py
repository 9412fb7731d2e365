"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage but the last takes documents and returns documents, with the same
columns. What a stage decides is written to the shared folder in narrow tables
before it returns, and its other tables are deleted by then; the narrow ones stay
until keepsake.llm.common.drop_results(), so stages of several pipelines may be
built and read in any order.

Edge cases. Null ids are kept as they are and count as the largest id where the
first of several rows stays. Null and empty texts fail the quality rules, so they go
in the first stage; a stage that is called by itself takes them like any other row. Rows
that share id and text are judged alike and stay or go together; rows that
share an id only are judged by their texts. An empty table passes through all
stages as an empty one. Other columns stay as they are, whatever their names; an
n_chars column, if there is one, follows the text where lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import decontam, jaccard, lines, packing, quality
from keepsake.llm.common import Scratch
from keepsake.llm.queries import TOKENIZER, table

_HAS_WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents have; those of which no word is left go."""
    left = lines.remove_repeated(docs, with_counts=True)
    left = left.where((F.size("removed") == 0) | F.col("_row.text").rlike(_HAS_WORD)).select("_row.*")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER))


STAGES = [(f.__name__, f) for f in (quality_rules, line_dedup, ngram_jaccard_join, benchmark_decontamination, best_fit_packing)]
#: SQL can express neither the fitted rules' verdict nor the packing; a test compares run() with the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as tmp:
        for name, stage in STAGES[:-1]:
            docs = tmp.save(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
