"""A corpus pipeline of the operators: each stage takes the documents that the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from tessera import storage
from tessera.llm import decontaminate, near_dup, packing, quality, suffix_dedup
from tessera.llm.queries import WORD_BPE, table, vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; without labels none are. See quality.stage for odd rows."""
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the smallest id's. See near_dup.stage for odd rows."""
    return near_dup.stage(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings out of the texts; no document goes. See suffix_dedup.stage for odd rows."""
    return suffix_dedup.stage(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages; null and empty texts stay. See decontaminate.stage for odd rows."""
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a null or empty text is one end token. See packing.pack for odd rows."""
    return packing.pack(docs, vocabulary(WORD_BPE))


STAGES = [("quality", classify), ("near_dup", near_duplicates), ("suffix_dedup", repeats), ("decontaminate", benchmark), ("packing", pack)]

#: SQL can't express the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage wrote besides its result goes as soon as the result is written.

    Tables may be empty or hold nulls, repeated rows and columns of any name; see the stages for what becomes of each.
    """
    docs, since = table(spark, sf_dir, "documents"), storage.mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = storage.written(docs, f"stage-{name}")
            storage.release(spark, since, keep=1)
    return docs
