"""Bottom-k sketches against plain Python sets: hashes, order of documents, estimates, merging and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hearthline.llm import fingerprints as P

SCHEMA = "doc_id long, text string"


def shingles(text, width=5):
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    words = [w for w in words if w]
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def sketch(text, size=P.SIZE):
    return b"".join(sorted(hashlib.md5(s.encode()).digest()[:8] for s in shingles(text))[:size])


def edited(rows, share=4):
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = {}
    for n, (d, t) in enumerate(docs):
        m = len(t) // share
        out[d, t] = t[:len(t) - m] + docs[(n + 1) % len(docs)][1][:m]
    return out


def words(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice("ab cd é🙂 Ef GHI jklm 日本 no. p".split()) + str(draw.randrange(9)) for _ in range(n))


ROWS = [(3, words(40, 1)), (1, words(400, 2)), (2, ""), (None, None), (None, "a b"), (7, words(300, 3)), (7, words(300, 3)), (7, "Same id, other text"), (-4, " \t\n"),
        (9, "one"), (10, "🙂" * 9), (11, words(30_000, 4)), (12, "x" * 300_000), (2 ** 40, "the END of all\x0bthings here")]


def test_edited_documents(spark):
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in ROWS], "doc_id long, text string, key string, n_chars int").repartition(5)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint)) for r in P.edited(docs).collect()), key=str)
    changed = edited(ROWS)
    want = sorted(((d, len(t or ""), hashlib.sha256(changed[d, t or ""].encode()).hexdigest(), sketch(t), sketch(changed[d, t or ""])) for d, t in ROWS), key=str)
    assert got == want


def test_single_and_no_documents(spark):
    [row] = P.edited(spark.createDataFrame([(5, "abcdefgh")], SCHEMA)).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.fingerprint == row.next_fingerprint
    assert P.edited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_next_document_over_many_partitions(spark):
    rows = [(i * 7 % 1000, f"text {i} " + "w " * (i % 30)) for i in range(1000)]
    changed = edited(rows)
    got = {r.doc_id: r.edited_sha256 for r in P.edited(spark.createDataFrame(rows, SCHEMA).repartition(16)).collect()}
    assert got == {d: hashlib.sha256(changed[d, t].encode()).hexdigest() for d, t in rows}


def estimates(spark, one, other):
    frame = P.add_fingerprint(spark.createDataFrame([(1, one), (2, other)], SCHEMA))
    a, b = (P.unpack(F.max(F.when(F.col("doc_id") == i, F.col("fingerprint")))) for i in (1, 2))
    return frame.agg(a.alias("a"), b.alias("b")).select(P.resemblance(F.col("a"), F.col("b")), P.containment(F.col("a"), F.col("b")), P.containment(F.col("b"), F.col("a")),
                                                        P.distinct_shingles(F.col("a"))).first()


@pytest.mark.parametrize("n, m", [(60, 30), (4000, 1500), (4000, 100)])
def test_estimates(spark, n, m):
    one = " ".join(f"w{i}" for i in range(n))
    other = " ".join(f"w{i}" for i in range(n - m, 2 * n))
    a, b = shingles(one), shingles(other)
    near, into, back, count = estimates(spark, one, other)
    slack = 0 if n < P.SIZE else 0.13
    assert abs(near - len(a & b) / len(a | b)) <= slack and abs(into - len(a & b) / len(a)) <= 2 * slack and abs(back - len(a & b) / len(b)) <= 2 * slack
    assert abs(count / len(a) - 1) <= (0 if n < P.SIZE else 0.3)


def test_empty_sets(spark):
    assert tuple(estimates(spark, "", None))[:3] == (1, 1, 1) and tuple(estimates(spark, "a b c", ""))[:3] == (0, 0, 1)


def test_merge_is_the_sketch_of_the_whole(spark):
    """Parts that overlap by four words; a third of all rows in one group; null groups; extra columns."""
    draw, rows, whole = random.Random(6), [], {}
    for n in range(60):
        group = "hot" if n % 3 else draw.choice(["x", None])
        text = words(700, n % 40)
        whole.setdefault(group, set()).update(shingles(text))
        w = text.split()
        rows += [(group, " ".join(w[i:i + 104]), "e") for i in range(0, len(w), 100)]
    frame = P.add_fingerprint(spark.createDataFrame(rows, "by0 string, text string, fingerprint string"))
    got = {r.by0: bytes(r.fingerprint) for r in P.merge(frame, ["by0"]).collect()}
    # the last part of a text may be shorter than five words and is then a shingle of its own
    short = {g: {s for r in rows if r[0] == g for s in shingles(r[1])} for g in whole}
    assert got == {g: b"".join(sorted(hashlib.md5(s.encode()).digest()[:8] for s in short[g])[:P.SIZE]) for g in whole}
    assert all(whole[g] <= short[g] for g in whole)


def test_clashing_names(spark):
    frame = spark.createDataFrame([("a b c d e f", 1, 2, 3)], "text string, row int, words int, made int")
    assert P.add_fingerprint(frame).columns == ["text", "row", "words", "made", "fingerprint"]
    assert P.edited(frame, key="made").columns[0] == "made"
