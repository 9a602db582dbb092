"""Pipeline over documents: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in the shared folder
of spark.checkpoint.dir and reads them again as the next one's docs.

In every stage columns other than those of documents are left out, so none can clash; an empty table gives an empty one; a very long text is
one row, judged whole; repeated rows are judged each, but for near-duplicates, which keep one of them. Null texts have no words and go
in the first stage. Null keys, languages, sources and counts are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.durable import remove, shared_folder
from boxloom.llm import decontaminate, mixing, quality, secrets, simhash
from boxloom.llm._common import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep. A null source is a host of its own."""
    verdict = quality.judge(docs.select(*COLUMNS), keep=COLUMNS, counts=False)
    return verdict.where("q_kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; a null doc_id comes last, ties are broken by a hash of the text."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; with an empty benchmark all. Null texts hold none."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.where("NOT dc_contaminated").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced, n_chars counted anew where one was. Null texts stay null, a null source is an empty path."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), keep=[c for c in COLUMNS if c != "text"])
    text = F.col("ss_redacted")
    n_chars = F.when(F.size("ss_findings") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count says, in a global random order. Rows with equal doc_id get equal counts; null is a doc_id."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the fingerprints' XXH64 or the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its Parquet, which stays; the folders of the stages before go as soon as the next one is written."""
    docs = read(spark, sf_dir, "documents")
    folder, done = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, done)
        done = f"{folder}/{name}"
    return docs
