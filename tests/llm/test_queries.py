"""The numbered queries against their SQL, and the pipeline's stages against brute force."""

import pytest
from brute import contamination, crowd, dedup_lines, near_copies
from check_oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from hearthline.llm import queries as Q
from hearthline.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_statement(spark, name):
    message, ok, _ = compare(spark, duck(SF), name, Q.queries()[name], Q.oracle_sql()[name], SF)
    assert ok, message


def test_all_are_registered():
    names = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in E.queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "1 2 3", "en", "src0", 5), (None, "the and of with was were", None, "src1", 24)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [len(P.STAGES), P.ORACLE_SQL] == [5, None]
    for name, stage in P.STAGES:
        out = cut_lineage(stage(spark, docs, SF))
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if stage is P.language:
            assert after == sorted(((d, t) for d, t in before if t and any(c.isalpha() for c in t)), key=str)
            assert out.where("lang IS NULL").count() == 0
            assert out.join(docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("lang").alias("own")), "doc_id").where("lang <> own").count() == 0
        elif stage is P.lines:
            assert after == sorted(((d, t) for d, t, _ in dedup_lines(before) if t.strip()), key=str)
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        elif stage is P.near_copies:
            _, part = near_copies(before, 80)
            assert after == sorted(((d, t) for d, t in before if d is None or part[d] == d), key=str)
        elif stage is P.benchmark:
            assert after == sorted(((d, t) for d, t in before for n, h, _ in [contamination(t, items)] if not (h and 20 * len(h) >= n)), key=str)
        else:
            taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()}
            for r in out.collect():
                assert r.copies in (1, 2) and abs(taken[r.source] - r.target) <= r.source_size
        if stage is not P.mix:
            assert out.columns == P.COLUMNS
        docs = out


@pytest.mark.parametrize("share, apart", [(0.5, 19), (0.88, 19)])
def test_near_copies_in_a_crowd_leave(spark, share, apart):
    rows = crowd(share, apart)
    _, part = near_copies(rows, 80)
    assert sum(part[d] != d for d in part) == 40
    docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_copies(spark, docs, SF).collect()) == sorted(d for d in part if part[d] == d)
