"""A corpus in five stages: quality, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontam, jaccard, lines, packing, quality
from cairn.llm.common import Scratch, cut, table

#: Near duplicates share this many words a shingle and at least this percentage of shingles.
SHINGLE, SIMILAR = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines and of long single lines go from the texts; n_chars follows where a text changed. All documents stay."""
    return lines.without_repeated_lines(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.keep_one_each(docs, SHINGLE, SIMILAR)


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of words for training."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark_leaks),
    ("best-fit packing", packed),
]
#: SQL cannot express the classifier; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        try:
            docs = scratch.write(stage(spark, docs, sf_dir))
        except BaseException:
            scratch.drop()
            raise
        finally:
            if last:
                last.drop()
        last = scratch
    with last:
        return cut(STAGES[-1][1](spark, docs, sf_dir))
