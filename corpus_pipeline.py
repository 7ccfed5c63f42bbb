"""The corpus pipeline: five stages over `documents`, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Missing values and empty tables follow the operators:
a document without a letter or without text is rejected by the first stage, one whose lines are all repeats leaves
with the second, rows with a null id are never near-duplicates, a null source is a source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import decontam, langid, linededup, minhash, mixing
from hearthline.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: similarity 0.8: twenty trees of depth three miss a pair at the threshold with probability below 0.000001; where all its
#: regions are full down to the last depth, with 0.000015
NEAR = minhash.Forest(percent=80, trees=20, depth=3)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents that name one; reject what is in none of them (und), name what has no name."""
    model = langid.fit(docs)
    named = langid.identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that an earlier line equals or nearly equals; documents of which only white space is left go."""
    short = linededup.dedup_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return short.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    others = minhash.link(docs, NEAR).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: each document with the number of its copies, one or two."""
    return mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("mixing to target weights", mix)]

#: SQL cannot state the language model, the edit join or the components; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = cut_lineage(docs) if number < len(STAGES) else docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
