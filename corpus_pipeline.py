"""The training-data pipeline: its stages in order, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.

Edge cases, for all stages: an empty table gives an empty one; texts are read whole at any
length; nulls in any column but the text are kept as they are, and rows without an id take
part; columns beyond those of ``documents`` come back unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import persisted, table
from ledgerlens.llm.decontaminate import remove_contaminated
from ledgerlens.llm.packing import pack
from ledgerlens.llm.quality_rules import keep_clean
from ledgerlens.llm.simhash import keep_one
from ledgerlens.llm.substring_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule, or whose host is rejected, go. Null, empty and blank
    texts fail; repeated rows stay or go together."""
    return keep_clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, and one
    without an id; of rows equal in id and text one stays."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows that stand anywhere else too are cut out of the texts; texts that
    lose nothing, null ones too, stay as they are."""
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a text without words holds none."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, length bucket, batch and place in the batch; a null or
    empty text is one end token."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SimHash, suffix automata and the tokenizer are beyond SQL; tests/llm holds a brute-force
#: version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir))
    return docs
