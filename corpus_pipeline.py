"""A corpus pipeline: language, toxicity, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run`
writes each stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import langid, linededup, nearcopies, packing, toxicity
from strandlog.llm.queries import TOXIC_AT, WORD_MODEL, remainder
from strandlog.runtime import cut, read

#: A document has no known language if the pooled probability of the best is nearer to chance than this part of the way to 1.
LEAST_LANGUAGE = 0.2
#: Texts whose fingerprints differ in so many bits or fewer are near copies, as in op1.
LINK_BITS = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    model = langid.fit(docs, remainder(5) != 0)
    return langid.keep_known(docs, model, langid.above_chance(len(model.langs), LEAST_LANGUAGE))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.keep_clean(docs, model, TOXIC_AT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in one of them."""
    return linededup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash fingerprints within two bits, found through anchors, or
    a Jaccard index of 0.8 or more over five-word shingles."""
    return nearcopies.keep_one(docs, LINK_BITS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 4096."""
    return packing.pack(docs, WORD_MODEL)


STAGES = [("language", language), ("toxicity", clean), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: The stages tokenise, train and cluster, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
