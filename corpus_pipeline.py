"""The corpus pipeline: quality rules, quality classifier, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

Defined cases are those of the operators; beside them, documents with a null id lose no lines and are never anyone's
near duplicate, and an empty table goes through all stages as an empty table.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowspark.llm import jaccard, line_dedup, packing, quality_classifier, quality_rules  # noqa: E402
from flowspark.llm.queries import CLOSING_ID, META, TOKENIZER  # noqa: E402
from flowspark.llm.tables import sized, stored, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality_rules.passing(docs.select(*COLUMNS))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier lets through."""
    models = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", META)
    return quality_classifier.score(docs, models, "text", META, keep=COLUMNS).where("kept").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; ``n_chars`` follows the text."""
    rows = line_dedup.dedup_lines(docs.select(*COLUMNS), "doc_id", "text")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies."""
    groups = jaccard.jaccard_components(docs, "doc_id", "text", SHINGLE_WORDS, SIMILAR_PERCENT)
    copies = stored(groups.where("component_id < doc_id").select("doc_id"), "copies")
    return docs.select(*COLUMNS).join(sized(copies), "doc_id", "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids in sequences of 4096."""
    return packing.pack_documents(docs, "doc_id", "text", TOKENIZER, CLOSING_ID)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("packing", packed),
]

#: A trained classifier decides, so SQL cannot state the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
