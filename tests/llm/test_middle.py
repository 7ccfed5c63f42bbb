"""SWAR marks and selects against plain loops, and whole transforms against a plain version and exact restoring."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import middle as M


def test_marks_of_every_byte():
    data = np.frombuffer(bytes(range(256)) * 2 + b"\n\n\x0b\x09\x8a\n", np.uint8)
    words = M.as_words(data)
    for marks, want in [(M.equal_bytes(words, 10), data == 10), (M.first_bytes(words), (data & 0xC0) != 0x80)]:
        assert (marks.view(np.uint8)[:len(data)] == want).all()
        found, places = M.Marks(marks), np.flatnonzero(want)
        assert (found.select(np.arange(1, len(places) + 1)) == places).all()
        assert (found.rank(np.arange(len(data) + 1)) == np.concatenate([[0], np.cumsum(want)])).all()


def plain_version(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    draw = random.Random(5)
    rows = [(0, None), (None, "a\nb"), (None, None), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "x<P>y"), (5, "<\nP>\n<S\n>"), (6, "no line feed"), (7, "é\n🙂🙂\n日本"), (7, "é\n🙂🙂\n日本"),
            (8, "z" * 500_000), (9, "line\n" * 60_000), (10, "\x00\n\x00"), (11, "<M>")]
    for i in range(12, 400):
        rows.append((i, "".join(draw.choice("ab é🙂日\n\n<>PSM") for _ in range(draw.randrange(60)))))
    return rows


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("char", 60, 30)])
def test_against_the_plain_version(spark, unit, rate, spm):
    rows = texts()
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int, form string").repartition(6)
    found = M.fill_in_middle(docs, unit=unit, rate=rate, spm_rate=spm)
    assert found.columns == ["doc_id", "text", "row", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    for r in found.withColumn("back", M.restore(F.col("output"), F.col("form"))).collect():
        d, t = rows[r.row]
        assert (r.doc_id, r.text) == (d, t) and r.back == (t or "")
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(d, t, unit, 7, rate, spm)


def test_empty_and_nested(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(1, "a\nb", [1, None], (2, "z"), "q", "w")], "c0 int, text string, t array<int>, h struct<a:int,b:string>, `x.y` string, output string")
    [row] = M.fill_in_middle(odd, key="c0").collect()
    assert (row.t, tuple(row.h), row["x.y"]) == ([1, None], (2, "z"), "q")
    with pytest.raises(ValueError):
        M.fill_in_middle(odd, key="c0", unit="word")
