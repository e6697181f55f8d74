"""The corpus pipeline: quality, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return rows of
`documents`; the last returns the packed pieces. The stages' rules cannot all be expressed in SQL
(trained forest, tokenizer), so ORACLE_SQL is None and tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import decontaminate, jaccard_join, packing, quality, secrets
from docketry.llm.queries import tokenizer_path
from docketry.llm.tables import read_table, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules or stray too far from their language go."""
    given = docs.select("doc_id", "lang", "text", F.struct("*").alias("given"))
    return quality.judge(given, quality.references(docs), keep=("given",)).filter("kept").select("given.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.redact(docs, secrets.scan(docs, model))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None

#: rows go to the tasks' Python in batches of so many bytes, so that long texts take no more memory than short ones
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    spark.conf.set(*BATCH_BYTES)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
