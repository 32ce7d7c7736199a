"""A training corpus from `documents`: good texts, without common lines, one of each near-duplicate class, mixed by source,
packed. Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns
of documents, with n_chars counted anew where a text changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import line_dedup, mixing, near_dedup, packing, quality
from tracewell.llm.common import written


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*columns)


def quality_classifier(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def common_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.line_dedup(docs), docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mixed_documents(docs), docs.columns)


def sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", common_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", sequences),
]

#: The classifier and the join are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
