"""Parts that run without a session: hashing of substrings, edit automata, archives."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, edit, license_places

from hearthline.llm import bytecode as B
from hearthline.llm import licenses, linededup, suffixes, warc


def test_words_and_hashes_of_rows():
    texts = ["Ab c", None, "", "c abé c", "  ", "x" * 50]
    seen = {}
    for chunk in B.chunks(pa.array(texts), limit=8):
        low = chunk.lower()
        starts, ends, first = low.words(B.WORDY)
        codes = B.pieces(low.sums(), starts, ends)
        for r in range(low.rows):
            own = [low.data[s:e].tobytes() for s, e in zip(starts[first[r]:first[r + 1]], ends[first[r]:first[r + 1]])]
            assert own == WORD.findall((texts[low.first + r] or "").lower().encode())
            for w, c in zip(own, codes[first[r]:first[r + 1]]):
                assert seen.setdefault(w, c) == c
    assert len(set(seen.values())) == len(seen) == 4


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_automaton_is_edit_distance(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(600):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 14)))
        b = bytearray(a)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(0, len(b) + 1)
            b[k:k + rng.randrange(0, 2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 2)))
        pairs.append((a, bytes(b)))
    got = linededup.within([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert got.tolist() == [edit(a, b) <= edits for a, b in pairs]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_lines_within_reach_share_a_key(k):
    rng = random.Random(k)
    for _ in range(300):
        a = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(20, 40)))
        b = bytearray(a)
        for _ in range(2):
            at = rng.randrange(0, len(b))
            b[at:at + rng.randrange(0, 2)] = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 2)))
        b = bytes(b)
        keys = []
        for x in (a, b):
            data = np.frombuffer(x, dtype=np.uint8)
            key, _, index = linededup.line_keys(B.Chunk(data, np.array([0, len(x)]), 0).sums(), np.array([0]), np.array([len(x)]), 2, k)
            keys.append((set(key[index].tolist()), set(key.tolist())))
        if len(a) >= len(b):
            assert keys[1][0] & keys[0][1], (a, b)
        else:
            assert keys[0][0] & keys[1][1], (a, b)


def test_runs_cover_every_window_once():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 9, 10, 11, 60, 200)]
    for chunk in B.chunks(pa.array(texts), limit=1 << 20):
        _, _, row, start, length = suffixes.runs(chunk, 10, 4)
        seen = [(r, s + i) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist()) for i in range(n - 9)]
        assert sorted(seen) == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 9)]


def test_archive_of_one_stream_or_of_members():
    rows = [(1, "http://a b\n", b"x" * 5, "d1", "response", None), (None, None, b"", "d2", "response", None), (3, "u", b"y\r\n\r\nz" * 900, "d3", "revisit", 1)]
    raws = [warc.record(*r) for r in rows]
    whole = zlib.compressobj(4, zlib.DEFLATED, 31)
    one = whole.compress(b"".join(raws)) + whole.flush()
    many = b"".join((c := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(r) + c.flush() for r in raws)
    for data in (one, many):
        assert list(warc.records_of(io.BytesIO(data))) == raws
    fields, payload = warc.parse(raws[2])
    assert payload == b"" and fields["x-payload-bytes"] == "5400" and fields["x-refers-to-page-id"] == "1"
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(zlib.compress(raws[0][:-3], wbits=31))))


def test_license_join_is_exact():
    rng = random.Random(3)
    vocabulary = "gnu general public license apache cc by mit granted x y".split()
    phrases = licenses.PHRASES + (licenses.Template("part", "gnu public granted license by", threshold=0.6, slack=1),)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    frequency = [rng.randrange(1, 99) for _ in licenses.Vocabulary(phrases).words]
    join = licenses._Join(phrases, frequency)
    need, own = 3, set("gnu public granted license by".split())
    for chunk in B.chunks(pa.array(texts), limit=300):
        n, found = join.finds(chunk.lower())
        for r in range(chunk.rows):
            text = texts[chunk.first + r]
            w = text.split()
            got = found.get(r, [])
            assert n[r] == len(w)
            assert sorted((x[2], x[0]) for x in got if x[1]) == license_places(text)
            blocks = {i for i in range(max(1, len(w) - 5)) if len(set(w[i:i + 6]) & own) >= need} if len(w) >= need else set()
            covered = {i for x in got if not x[1] for i in range(x[2], x[3] + 1)}
            assert blocks <= covered and bool(blocks) == bool(covered)
