"""The numbered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import statements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import cut_lineage
    from .quality import classify, fit, statistics
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    measured = cut_lineage(statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("held_out", held_out))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(measured.where(~F.col("held_out")).join(labels, "doc_id"))
    return classify(measured, model).select("doc_id", "held_out", "score", "predicted")


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("finds", lambda x: x.phrase)

    def named(rows):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(rows, lambda x: x.label))))
    best = F.coalesce(F.array_max(F.transform("finds", lambda x: x.containment)), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
                        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"), named(base).alias("base_labels"), named(F.col("finds")).alias("labels"),
                        best.alias("score"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip
    records, _ = round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import is_contaminated, scan
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated(F.col("n_words"), n_hit).alias("contaminated"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were removed, and digests of the numbers of those and of the text that stays."""
    from .linededup import dedup_lines
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"),
                        F.sha2(F.concat_ws(",", F.transform("removed_lines", lambda x: x.cast("string"))), 256).alias("removed_sha256"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import link
    return link(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import link
    return link(table(spark, sf_dir, "embeddings"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited, resemblance, unpack
    found = edited(table(spark, sf_dir, "documents"))
    hashes = found.select("*", unpack(F.col("fingerprint")).alias("a"), unpack(F.col("edited_fingerprint")).alias("b"), unpack(F.col("next_fingerprint")).alias("c"))

    def printed(sketch):
        return F.translate(F.base64(sketch), "\r\n", "")  # without line breaks
    return hashes.select("doc_id", "n_chars", "edited_sha256", printed("fingerprint").alias("fingerprint"), printed("edited_fingerprint").alias("edited_fingerprint"),
                         resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("c")).alias("near_next"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is cast to a long, which ends in an error beyond its range (some millions of vectors); the operator itself gives it whole."""
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restore
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(statements.SQL)
