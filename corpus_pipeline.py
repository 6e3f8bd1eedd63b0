"""The training-data pipeline: documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return
the columns of documents. A null or empty text is scored, fingerprinted, kept and packed like any other. Rows that
repeat a doc_id and its text count as copies of each other; of those the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import new_folder, table
from topicloom.llm.decontamination import contaminated, with_hits
from topicloom.llm.packing import best_fit_packing
from topicloom.llm.quality import fit, score
from topicloom.llm.secrets import redacted
from topicloom.llm.simhash import one_of_each

#: Documents below this score are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier, trained on labelled ones of ``docs``, doesn't reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score(F.col("text").cast("string"), model) >= QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth of the words lies in benchmark passages."""
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), "__found")
    return found.filter(~contaminated("__found")).drop("__found")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return redacted(docs, weak_pairs=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        result = function(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return result
        folder = new_folder(spark, f"pipeline-{i}")
        result.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
