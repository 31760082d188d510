"""A pipeline of the training-data operators over ``documents``: toxic
documents go, exact copies go, one document of each group of near copies
stays, sources are mixed to their target weights, and what is left is packed
into bins.

Each stage works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. The mix repeats documents, so doc_id is
not unique after it. Nulls, empty texts, repeated rows and empty tables have
the results that the operators define.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession

from shortlist.llm.exact_dedup import exact_dedup
from shortlist.llm.minhash_dedup import near_dedup
from shortlist.llm.mixing import mixed_documents
from shortlist.llm.packing import pack
from shortlist.llm.toxicity import without_toxic
from shortlist.session import checkpoint_dir
from shortlist.sources.tables import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix),
          ("packing", packing)]

#: The classifier and the packing cannot be stated in SQL; the stages are
#: tested against brute force in tests/llm.
ORACLE_SQL = None

#: Numbers the runs of a session, so that each has a folder of its own.
_RUNS = count()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to
    the checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    out = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{next(_RUNS)}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{out}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
