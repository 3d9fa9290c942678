"""From raw documents to a training mix: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Extra columns pass through. Empty documents give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from guardframe.llm.common import row_hash, shared_folder, table
from guardframe.llm.decontaminate import contaminated
from guardframe.llm.lines import line_dedup
from guardframe.llm.mixing import source_mix
from guardframe.llm.quality import quality_scores
from guardframe.llm.simhash import near_groups


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two columns that hash the whole row, and their names; a repeated or null id is no matter, equal rows share them."""
    names = ["row_h1", "row_h2"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    return docs.select(*docs.columns, *(h.alias(n) for h, n in zip(row_hash(*docs.columns), names))), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble does not reject, learned from all labels; each row is judged by its own text."""
    rows, key = keyed(docs)
    gone = quality_scores(rows, table(spark, sf_dir, "labels"), F.lit(False), keep=key).where("predicted = 0").select(*key).distinct()
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of many sources; n_chars follows the text."""
    out = line_dedup(docs, report=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one of the least id.

    Rows that share an id are compared like any others, and of equal rows one stays. A null
    id comes after all others, so such a row stays only where its group has no id.
    """
    rows, key = keyed(docs)
    source = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(k).alias(h) for k, h in zip(key, ("h1", "h2"))), "text")
    _, kept = near_groups(source)
    number = f"{key[0]}_n"
    # Spark applies the limit of one before the exchange too
    once = rows.withColumn(number, F.row_number().over(W.partitionBy(*key).orderBy(key[0]))).where(F.col(number) == 1)
    return once.join(kept.toDF(*key), key, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; each row is judged by its own text."""
    rows, key = keyed(docs)
    gone = contaminated(rows, table(spark, sf_dir, "benchmark"), keep=key).select(*key).distinct()
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return source_mix(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source mix", mix),
]

#: The first stage fits a model and the third links by fingerprints, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a table in the shared folder after each."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
