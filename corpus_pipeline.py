"""The training-data pipeline: stages that each read what the one before has written.

Results for special rows, in every stage: a null or empty text is a document without words,
which the quality rules reject; a document with a null doc_id is judged by the quality
rules and the secret scan alone, being no copy of another and having no hits; repeated rows
stand or fall together; an empty table gives an empty
one; columns of any name go through unchanged. The last stage gives one row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.bpe import token_digests
from palisade.llm.decontaminate import contamination
from palisade.llm.minhash_dedup import near_duplicates
from palisade.llm.quality_rules import with_quality
from palisade.llm.secret_scan import redact
from palisade.llm.workspace import Workspace

#: Folders of the stages before, deleted when the next stage has their result as a table.
_folders: list[Workspace] = []


def _workspace(spark: SparkSession, name: str) -> Workspace:
    while _folders:
        _folders.pop().release()
    _folders.append(Workspace(spark, name))
    return _folders[-1]


def _columns(docs: DataFrame) -> list:
    """The documents' columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    _workspace(spark, "quality")
    return with_quality(docs).filter("kept").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles."""
    found = near_duplicates(docs, workspace=_workspace(spark, "dedup"))
    dropped = found.filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), workspace=_workspace(spark, "winnow"))
    return docs.join(found.filter("contaminated").select("doc_id"), "doc_id", "left_anti").select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    _workspace(spark, "secrets")
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    _workspace(spark, "tokens")
    return token_digests(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("secret scan", secrets), ("bpe", tokens)]

#: Near-duplicate components and byte-pair encoding are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
