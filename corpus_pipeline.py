"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality: documents that the quality rules reject go. near_copies: of each component of the Jaccard join the document with the
least doc_id stays. decontamination: documents that hold a benchmark item go. secrets: secrets in texts are replaced by
[kind]; n_chars follows the new text. pieces: the ids' digests of what is left, by document.

Stages but the last return the columns of documents; a null text has no words, so quality drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import decontaminate, jaccard, pieces, quality, secrets
from veriframe.llm.common import complete, shared_folder
from veriframe.llm.queries import table, tokenizer_file

#: Near copies share this much of their runs of so many words; op8_jaccard_join has 90 and 3.
NEAR_PERCENT, NEAR_WIDTH = 80, 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.without_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("pieces", pieces_stage)]

#: The pieces stage has no SQL form; run() is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; the tables between them lie in folder, a fresh one in the shared folder where none is given.

    A run that was lost is taken up by giving its folder again: stages whose tables are complete (_SUCCESS) aren't run once more.
    Two runs at one time need folders of their own."""
    docs, folder = table(spark, sf_dir, "documents"), folder or shared_folder(spark)
    for name, stage in STAGES:
        if not complete(spark, f"{folder}/{name}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
