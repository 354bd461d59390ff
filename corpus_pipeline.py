"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes and, but for the last, returns the columns of ``documents`` and
any others, whatever their names.  Null ids, sources and languages are values like
others; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import linededup, mixing, neardup, packing, quality
from strandloom.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep, without their failed lines.

    Null, empty and short texts go; rows that repeat are judged each.
    """
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents; of each group of like lines one occurrence stays.

    A document that loses all lines is empty but stays; a null text stays null;
    rows with equal id and text keep and lose the same lines.
    """
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    All texts without words, null ones too, are one group; of rows with equal id
    and text one stays.
    """
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Documents without a word have no size and bear on no target; rows that repeat
    are taken each; a null source is a source.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    A null or empty text is one token; long texts are cut whole into pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenisers and similarity verification have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
