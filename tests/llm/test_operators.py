"""The operators on small tables with missing, empty, long, repeated and clashing values, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination, crowd, dedup_lines, license_places, near_copies, repeats
from pyspark.sql import functions as F

from hearthline.llm import bytecode as B
from hearthline.llm import decontam, embeddings, graph, langid, licenses, linededup, minhash, mixing, quality, suffixes, warc

DOC = "doc_id long, text string"


def _texts(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, an empty one, a long one, repeated rows and a null id."""
    rng = random.Random(seed)
    word = ["alpha", "beta", "Gamma", "delta,", "été", "omega", "12", "kappa", "sigma.", "tau"]
    line = lambda k: " ".join(rng.choice(word) + str(rng.randrange(40)) for _ in range(k))
    shared = [line(14), line(9)]
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(shared) if rng.random() < 0.2 else line(rng.randrange(1, 20)) for _ in range(rng.randrange(1, 6)))
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1]
            if rng.random() < 0.7:
                k = rng.randrange(len(text) + 1)
                text = text[:k] + rng.choice(["", "q", "zz"]) + text[k + rng.randrange(3):]
        rows.append((i * 3, text))
    rows += [(1, None), (2, ""), (5, " \n\n"), (7, "one two"), (8, "one two"), (10, line(4000)), (None, rows[0][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _texts()


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100} | {500 + i: 500 for i in range(50)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_copies(spark, rows):
    for forest in (minhash.Forest(), minhash.Forest(region=3, sample=8)):
        got = minhash.link(spark.createDataFrame(rows, DOC), forest).collect()
        sets, part = near_copies(rows, 85)
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), part[r.doc_id], part[r.doc_id] == r.doc_id)
    assert minhash.link(spark.createDataFrame([], DOC)).count() == 0


def test_a_crowd_around_one_text_stays_whole(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(5, " ".join(base))]
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([1, 2, 2, 4])):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((10 + i, " ".join(own)))
    _, part = near_copies(rows, 85)
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, DOC), minhash.Forest(region=8, sample=32)).collect()}
    assert got == part


@pytest.mark.parametrize("share, apart, options", [(0.5, 13, {}), (0.5, 15, {"region": 3, "block": 8}), (0.91, 14, {}), (0.91, 13, {"region": 3, "block": 8, "load": 900})])
def test_pairs_in_a_crowd_are_found_away_from_its_pivot(spark, share, apart, options):
    rows = crowd(share, apart)
    _, part = near_copies(rows, 85)
    assert sum(part[d] != d for d in part) == 40
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, DOC), minhash.Forest(**options)).collect()}
    assert got == part


def test_small_blocks_of_full_regions_equal_brute_force(spark, rows):
    _, part = near_copies(rows, 85)
    got = minhash.link(spark.createDataFrame(rows, DOC), minhash.Forest(region=2, sample=4, block=2)).collect()
    assert all(r.component_id == (None if r.doc_id is None else part[r.doc_id]) for r in got)


def test_deeper_regions_and_their_blocks_equal_brute_force(spark):
    forest, rng = minhash.Forest(percent=97, trees=4, depth=2, region=3, orders=40, block=2, load=40), random.Random(4)
    assert forest.deepest >= forest.depth + 2
    common = [1] * forest.values
    signs = {i: [v if rng.random() < 0.85 else rng.randrange(3) for v in common] for i in range(1, 31)}
    comp, size = {i: i if i % 3 else 3 for i in signs}, {i: 5 + i for i in signs}
    want = collections.Counter()

    def settle(reps, place, depth):
        for group in group_by(reps, lambda i: tuple(signs[i][p] for p in place[:depth])):
            if len({comp[i] for i in group}) == 1:
                continue
            if len(group) > forest.region and depth < forest.deepest:
                settle(group, place, depth + 1)
                continue
            main = max((sum(comp[j] == comp[i] for j in group), comp[i]) for i in group)[1]
            sides = [[size[i] for i in group if (comp[i] != main) == out] for out in (True, False)]
            k, m = (math.ceil(max(len(side) / forest.block, sum(side) / forest.load)) for side in sides)
            want[frozenset((i, size[i], comp[i], comp[i] != main, k, m) for i in group)] += 1

    def group_by(reps, of):
        groups = collections.defaultdict(list)
        for i in reps:
            groups[of(i)].append(i)
        return groups.values()
    for place in forest.permutations():
        settle(signs, place, forest.depth + 1)
    rows = [(i, size[i], comp[i], np.array(signs[i], dtype=np.uint32).tobytes()) for i in signs]
    got = collections.defaultdict(set)
    for r in minhash.deepened(spark.createDataFrame(rows, "rep long, n long, comp long, sign binary"), forest).collect():
        got[r.region].add((r.rep, r.n, r.comp, r.out, r.k, r.m))
    assert collections.Counter(map(frozenset, got.values())) == want and len(want) > 40


def test_lines(spark, rows):
    want = sorted(dedup_lines(rows), key=str)
    named = spark.createDataFrame([(d, t, 1, "a") for d, t in rows], "doc_id long, text string, removed_lines int, row string")
    for plan in (linededup.Edits(), linededup.Edits(crowd=2, block=2)):
        got = linededup.dedup_lines(named, plan)
        assert got.columns == ["doc_id", "text", "row", "removed_lines"]
        assert sorted(((r.doc_id, r.text, r.removed_lines) for r in got.collect()), key=str) == want
    assert linededup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def test_repeats(spark, rows):
    got = suffixes.remove_repeats(spark.createDataFrame(rows, DOC)).collect()
    own = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(own, key=str) == sorted(repeats(rows), key=str)
    assert sum(x[2] for x in own) > 0
    assert all(sum(s.last - s["first"] + 1 for s in r.spans) == r.n_bytes - len(r.kept) for r in got)
    assert suffixes.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def test_repeats_of_short_windows_in_a_small_alphabet(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, DOC), window=9, gram=3).collect()
    want = {x[0]: x[1:] for x in repeats(rows, 9)}
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_decontamination(spark, rows):
    passage = next(t for d, t in rows if t and len(t.split()) > 30)
    items = [(1, passage), (2, "one two"), (3, None), (4, ""), (None, "kappa5"), (1, passage), (6, "never seen words")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, items string, c1 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [("null" if i is None else i, t) for i, t in items]
    for size in (10_000, 7):
        got = decontam.scan(docs, bench, slice_windows=size).collect()
        own = sorted(((r.doc_id, r.text, r.n_words, tuple(r.hit_words), tuple(r["items"])) for r in got), key=str)
        want = sorted(((d, t, n, tuple(sorted(h)), tuple(i)) for d, t in rows for n, h, i in [contamination(t, known)]), key=str)
        assert own == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not (h and 20 * len(h) >= n) for _, t in rows for n, h, _ in [contamination(t, known)])
    cut = decontam.remove_spans(docs, bench)
    assert cut.count() == len(rows) and cut.where(F.col("doc_id") == 7).first().text == ""
    assert decontam.scan(docs, bench.limit(0)).where(F.size("hit_words") > 0).count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0


def test_mixing(spark, rows):
    rng = random.Random(4)
    table = [(d, t, rng.choice(["b", "a", "c", None, "b", "b"]), 9) for d, t in rows]
    got = mixing.mix_sources(spark.createDataFrame(table, "doc_id long, text string, source string, size int")).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len((t or "").encode().split())) for d, t, _, _ in table)
    by, total = {}, sum(r.size for r in got)
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r.size
        s[1] += r.size * r.copies
        assert 0 <= r.copies <= 2 and r.target <= 2 * r.source_size + 1e-6
    assert all(s[0] == s[2] for s in by.values())
    assert sum(s[3] for s in by.values()) == pytest.approx(1.5 * total)
    for name, s in by.items():
        assert abs(s[1] - s[3]) <= max(r.size for r in got if r.source == name)
    same = {}
    for r in got:
        assert same.setdefault((r.doc_id, r.source), r.copies) == r.copies
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target) for r in empty] == [(0, 0.0)] * 2


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "u", big), (9, None, big), (4, "v", big), (None, "w", big), (5, "x", "short"), (6, "x", "short"), (7, "x", None), (8, "y", "z" * 200_000), (9, "again", big)]
    records, index = warc.round_trip(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int"))
    got = records.collect()
    assert len(got) == index.count() == len(pages)
    for r in got:
        html = next(h or "" for p, _, h in pages if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = r.page_id in (1, 4, None)
        assert (r.record_type, r.refers_to, bytes(r.payload)) == (("revisit", 9, b"") if revisit else ("response", None, html))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))[0].count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    d = 16
    base = rng.standard_normal((40, d))
    vectors = [base[i % 40] + rng.standard_normal(d) * rng.choice([0.02, 0.15, 0.3]) for i in range(300)]
    vectors += [vectors[0]] * 30 + [vectors[1] * 7.5]
    table = [(i * 2, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1001, None), (1003, [0.0] * d), (1005, [float("nan")] + [1.0] * (d - 1)), (1007, [None] + [1.0] * (d - 1)), (1009, [float("inf")] * d), (1011, [1.0, 2.0]), (None, vectors[0].tolist())]
    for plan in (embeddings.Plan(), embeddings.Plan(block=4)):
        got = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(table + odd, "vec_id long, embedding array<double>"), plan).collect()}
        x = np.array(vectors)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        close = x @ x.T >= 0.95
        root = np.arange(len(x))
        for _ in range(len(x)):
            root = np.array([root[close[i]].min() for i in range(len(x))])
        for i in range(len(x)):
            r = got[2 * i]
            assert (r.n_links, r.component_id, r.kept) == (close[i].sum() - 1, 2 * root[i], root[i] == i)
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd if i is not None)
        assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for d in (3, 16, 40):
        for _ in range(30):
            v = rng.normal(size=d)
            for x in (v, 2 * v, v + rng.normal(size=d) * 0.05 * np.linalg.norm(v) / d ** 0.5):
                rows.append((at, x.tolist()))
                at += 1
    rows += [(at, [2.0]), (at + 1, [5.0]), (at + 2, [-1.0]), (at + 3, [1.0, 2.0, 3.0, 4.0, 5.0])]
    links = {i: sum(len(v) == len(w) and i != j and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95 for j, w in rows) for i, v in rows}
    got = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert (got[at + 1].component_id, got[at + 2].component_id, got[at + 3].kept) == (at, at + 2, True)


def _tongues(n, each=12, seed=4):
    """Texts in n invented languages of 40 words each."""
    rng = random.Random(seed)
    rows = []
    for tongue in range(n):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(120)), f"l{tongue:03d}") for i in range(each)]
    return rows


def _plain_grams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    return [data[i:i + n] for n in langid.SIZES for i in range(len(data) - n + 1) if 32 not in data[i + 1:i + n - 1]]


@pytest.mark.parametrize("n, max_bits", [(3, 22), (100, 22), (3, 16)])
def test_filters_hold_the_typical_grams(spark, n, max_bits):
    rows = _tongues(n)
    train = [r for r in rows if r[0] % 4]
    frame = spark.createDataFrame(train, DOC + ", lang string")
    model = langid.fit(frame, max_bits=max_bits)
    assert len(model.langs) == n and model.slots.shape[0] == -(-n // 63) and model.wrong.max() < 0.3
    seen = {}
    for _, text, lang in train:
        own = seen.setdefault(lang, {})
        for g in _plain_grams(text):
            own[g] = own.get(g, 0) + 1
    totals = {x: sum(own.values()) for x, own in seen.items()}
    top = {}
    for x, own in seen.items():
        for g, k in own.items():
            if k >= 5:
                top[g] = max(top.get(g, 0), k / totals[x])
    texts = [t for _, t, _ in rows[::4]][:12] + ["Ünder, the   12 sky", ""]
    counts = np.zeros((len(texts), n))
    for chunk in B.chunks(pa.array(texts)):
        for codes, first in langid.grams(chunk):
            counts[chunk.first:chunk.first + chunk.rows] += model.counts(codes, first)
    for t, text in enumerate(texts):
        own = _plain_grams(text)
        for i, x in enumerate(model.langs):
            true = sum(seen[x].get(g, 0) >= 5 and seen[x][g] / totals[x] >= 0.25 * top[g] for g in own)
            assert counts[t, i] >= true  # no gram is missed
            corrected = (counts[t, i] - len(own) * model.wrong[i]) / (1 - model.wrong[i])
            assert abs(corrected - true) <= 5 + 0.05 * len(own)
    held = spark.createDataFrame([r for r in rows if r[0] % 4 == 0], DOC + ", lang string")
    found = langid.identify(held.withColumn("lang_0", F.lit("x")).withColumn("Score_0", F.lit(1)), model)
    assert found.where("lang_pred <> lang").count() == 0 and {"lang_0", "Score_0"} <= set(found.columns)


def test_long_filters_leave_out_rare_grams_first():
    sizes = [(0, 2, 9_000), (0, 5, 2_000), (1, 3, 500)]
    assert langid._length(sizes, 22) == (17, 0) and langid._length(sizes, 16) == (16, 3) and langid._length([], 22) == (16, 0)


def test_training_sample_is_bounded_for_copies_and_keeps_rare_languages(spark):
    rows = [(i, "alpha beta gamma delta " * 5, "aa") for i in range(6_000)] + [(i + 6_000, "omega kappa sigma tau " * 5, "zz") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, DOC + ", lang string"), lang_rows=500)
    assert model.langs == ["aa", "zz"] and model.usual == 0
    got = langid.identify(spark.createDataFrame([(1, "kappa sigma"), (2, "gamma beta")], DOC), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "zz", 2: "aa"}


def _plain_statistics(text):
    """The statistics of one text, word by word and line by line."""
    data = text.encode()
    words, lines = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w], [x for x in data.split(b"\n") if x]
    share = lambda some, whole: sum(some) / max(1, len(whole))
    of_bytes = lambda chars: share([b in chars for b in data], data)
    upper, symbols = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^~_=+<>{}[]\\/"
    return [np.log1p(len(data)), np.log1p(len(words)), share([len(w) for w in words], words), share([len(w) > 14 for w in words], words),
            share([len(w) < 4 for w in words], words), len(words) / max(1, len(lines)), of_bytes(upper), of_bytes(b"0123456789"), of_bytes(symbols), of_bytes(b".,;:!?"),
            of_bytes(b"|"), of_bytes(b" \t\n\x0b\x0c\r"), share([b >= 128 for b in data], data), share([w[-1] in symbols for w in words], words),
            share([w[-1:] == b"!" for w in words], words), len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)),
            share([len(x) < 20 for x in lines], lines), share([2 * sum(b in upper for b in w) > len(w) for w in words], words)]


def test_statistics_and_rules_equal_the_plain_ones(spark, rows):
    more = [t or "" for _, t in rows] + ["BUY NOW!!! $$$ | a|b\n\nBUY NOW!!! 123\tx_", "   ", "\n\n", "ÉTÉ été " * 30]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(more)], DOC + ", STAT_pipe string")
    measured = quality.statistics(docs)
    names = [f"stat_{s}" for s in quality.STATS]
    assert measured.columns == ["doc_id", *names]
    got = {r.doc_id: r for r in measured.collect()}
    for i, t in enumerate(more):
        assert np.allclose([got[i][c] for c in names], _plain_statistics(t), rtol=1e-12, atol=1e-12)
    model = quality.RuleModel([(((0, True, 4.0),), 0.7), (((1, False, 2.0), (9, True, 0.05)), -1.25), (((15, False, 0.5), (0, False, 3.0), (0, True, 6.0)), 2.0)], -0.5)
    for r in quality.classify(measured, model).collect():
        total = model.intercept
        for rule, weight in model.rules:
            total += weight * all((got[r.doc_id][names[k]] <= bound) == below for k, below, bound in rule)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12 and r.predicted == (r.score >= 0.3)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held))
    found = langid.identify(docs.where(held).withColumn("score", F.lit("old")), model)
    right, all_ = found.where("lang = lang_pred").count(), found.count()
    assert right / all_ > 0.97 and found.where("score < 0 OR score > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! \n"), (4, "ж"), (5, "the and of with " * 20_000)], DOC)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.langs and got[5][0] == "en"
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    measured = quality.statistics(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where(F.col("text").isNotNull()))
    model = quality.fit(measured.where(~held).join(labels, "doc_id"))
    rows = quality.classify(measured.where(held).join(labels, "doc_id"), model).collect()
    good, bad = [r.score for r in rows if r.label == 1], [r.score for r in rows if r.label == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    odd = quality.statistics(spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (3, "word " * 50_000, 2.0), (3, "word " * 50_000, 2.0)], DOC + ", score double"))
    got = quality.classify(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    none = quality.fit(measured.limit(0).withColumn("label", F.lit(1)))
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    one = quality.fit(measured.limit(5).withColumn("label", F.lit(1)))
    assert quality.classify(odd, one).first().predicted == 1


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "cc by nc. Licensed under CC BY-NC 4.0 mit license, mit license"), (5, "gnu general public " * 30_000 + "license"),
            (5, "x"), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = licenses.scan(spark.createDataFrame([(*r, "z") for r in rows], DOC + ", finds string"))
    for r in got.collect():
        text = next(t for d, t in rows if d == r.doc_id and (t or "").count(" ") == (r.text or "").count(" "))
        assert sorted((x["first"], x.label) for x in r.finds if x.phrase) == license_places(text)
        if r.doc_id in (4, 6):
            assert {4: "cc-by-nc", 6: "gpl-3.0"}[r.doc_id] in {x.label for x in r.finds}
    assert got.limit(0).count() == 0 and licenses.scan(spark.createDataFrame([], DOC)).count() == 0
