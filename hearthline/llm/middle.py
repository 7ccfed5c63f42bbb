"""Fill-in-middle: cut whole texts at unit ends and reorder prefix, middle and suffix, found by SWAR words.

A batch of texts is one UTF-8 buffer, viewed as 64-bit words. Bytes that end a unit are marked arithmetically, eight at a
time, `bitwise_count` gives each word's marks and their running sum answers both questions: how many units end before a
byte (rank), and which byte ends the k-th unit (select: search the running sum for the word, then resolve the place inside
the word from byte-wise prefix sums made by one multiplication). All rows of a batch are answered at once. Units are lines
(a last line without line feed is one too) or code points. Nothing is shuffled; a batch holds at most `spark.sql.execution.
arrow.maxBytesPerBatch` bytes or one text.

Where to cut and which form a text takes follow from a hash of its id, so that reruns agree:
h1 to h4 are the first four 32-bit numbers of sha256("<seed>:<id>"). A null text is empty, a null id counts as the word
"null", rows with equal ids and texts get equal results. A text that is empty, holds one of the markers or is not drawn
stays plain. An empty table gives an empty result. Columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = ["n_units", "form", "prefix_chars", "middle_chars", "output"]

ONES, LOW7, HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
SEVEN, SIX = np.uint64(7), np.uint64(6)


def as_words(data: np.ndarray) -> np.ndarray:
    """A byte buffer as little-endian 64-bit words, the last one filled with zero bytes."""
    padded = np.zeros(-(-len(data) // 8) * 8 or 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """1 in each byte that equals `byte`; no carry crosses a byte."""
    x = words ^ (ONES * np.uint64(byte))
    return (~(((x & LOW7) + LOW7) | x | LOW7)) >> SEVEN


def first_bytes(words: np.ndarray) -> np.ndarray:
    """1 in each byte that begins a code point (bits 7 and 6 are not 1 and 0)."""
    return ((words >> SEVEN) & ~(words >> SIX) & ONES) ^ ONES


class Marks:
    """Marked bytes of a buffer with their running count by word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)  # marks up to and with each word

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte position."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        full = np.where(word > 0, self.upto[np.maximum(word, 1) - 1], 0)
        here = self.marks[np.minimum(word, len(self.marks) - 1)]
        below = (np.uint64(1) << (inside << np.uint64(3))) - np.uint64(1)  # inside = 0 gives no byte
        return full + np.bitwise_count(here & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the k-th mark, k from 1 on."""
        word = np.searchsorted(self.upto, k, side="left")
        before = np.where(word > 0, self.upto[np.maximum(word, 1) - 1], 0)
        wanted = (k - before).astype(np.uint64)
        sums = self.marks[word] * ONES  # byte i: marks in bytes 0 to i
        reached = ((sums | HIGH) - wanted * ONES) & HIGH  # high bit where that sum is at least the wanted one
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each text, byte positions after prefix and middle, and their lengths in code points.

    starts and ends bound the texts in the buffer; h1 and h2 draw the two unit numbers.
    """
    words = as_words(data)
    points = Marks(first_bytes(words))
    if unit == "line":
        marks = Marks(equal_bytes(words, 10))
        first = marks.rank(starts)
        closed = marks.rank(ends) - first
        open_end = (ends > starts) & (data[np.maximum(ends, 1) - 1] != 10) if len(data) else np.zeros(len(starts), bool)
        n = closed + open_end
    else:
        marks, first = points, points.rank(starts)
        n = closed = points.rank(ends) - first
    a, b = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))

    def after(k: np.ndarray) -> np.ndarray:
        """Position after k units: the k-th marked byte ends a line; a code point ends where the next one begins."""
        wanted = k if unit == "line" else k + 1
        there = (wanted > 0) & (wanted <= closed)
        place = np.where(k == 0, starts, ends)
        place[there] = marks.select((first + wanted)[there]) + (1 if unit == "line" else 0)
        return np.where(k == 0, starts, place)
    p, m = after(a), after(b)
    return n, p, m, points.rank(p) - points.rank(starts), points.rank(m) - points.rank(p)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and n + 1 offsets into them, whatever the slice and the offset width."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _transform(batches: Iterator[pa.RecordBatch], spots: tuple[int, ...], unit: str, rates: tuple[int, int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    text_at, hash_at, kept = spots
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(text_at)
        data, offsets = _bytes(text)
        starts, ends = offsets[:-1], offsets[1:]
        # 32 hex digits a row hold h1 to h4, eight each
        h = np.frombuffer(bytes.fromhex("".join(batch.column(hash_at).to_pylist())), ">u4").astype(np.int64).reshape(-1, 4)
        n, p, m, prefix, middle = cut(data, starts, ends, h[:, 0], h[:, 1], unit)
        spm = h[:, 3] % 100 < rates[1]
        drawn = (ends > starts) & (h[:, 2] % 100 < rates[0])
        body, marks = data.tobytes(), [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
        form, output = [], []
        for i in range(batch.num_rows):
            whole = body[starts[i]:ends[i]]
            if not drawn[i] or any(x in whole for x in marks):
                form.append("plain")
                output.append(whole)
                continue
            x, y = p[i] - starts[i], m[i] - starts[i]
            pre, mid, suf = whole[:x], whole[x:y], whole[y:]
            form.append("spm" if spm[i] else "psm")
            output.append(b"".join((marks[1], suf, marks[0], pre, marks[2], mid) if spm[i] else (marks[0], pre, marks[1], suf, marks[2], mid)))
        plain = np.array([f == "plain" for f in form])
        made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain),
                pa.array(output, pa.large_binary()).cast(pa.large_string())]
        columns = [batch.column(i) for i in range(kept)] + made
        yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema)], schema=schema)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and the output text.

    rate and spm_rate are percentages: of texts that are transformed, and of those that get the form spm.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    kept = [c for c in docs.columns if c not in MADE]
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 32)
    # numbered names inside: an input column may have any name
    inside = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), drawn.alias("h"))
    fields = [(f"c{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(kept)]
    types = dict(zip(MADE, ["bigint", "string", "bigint", "bigint", "string"]))
    schema = ", ".join(f"{n} {t}" for n, t in [*fields, *types.items()])
    frame = docs.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(frame.schema)
    spots = (len(kept), len(kept) + 1, len(kept))
    out = inside.mapInArrow(lambda batches: _transform(batches, spots, unit, (rate, spm_rate), arrow), frame.schema)
    return out.toDF(*kept, *MADE)


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for. A marker can't arise across a seam: it begins with its only `<`."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (F.when(form == "psm", F.concat(parts.getItem(1), parts.getItem(3), parts.getItem(2)))
            .when(form == "spm", F.concat(parts.getItem(2), parts.getItem(3), parts.getItem(1))).otherwise(output))
