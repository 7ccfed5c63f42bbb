"""Document fingerprints: bottom-k sketches of hashed word shingles, with DataFrame functions only.

A text's shingles are its runs of five words (A-Z lowered, words are runs of anything but white space); a text of one to
four words is one shingle, a text without words has none. The sketch is the `size` smallest distinct 64-bit hashes of the
shingles in order, 8 bytes each; a sketch with fewer hashes holds all of them. Sketches of parts merge into the sketch of
the whole: the smallest hashes of their union. From two sketches follow the resemblance of the shingle sets (the share of
the smallest hashes of the union that both hold), the containment of one in the other (the share of its hashes, up to the
lower of both ends, that the other holds) and from one the number of distinct shingles.

`edited` compares each document with a text whose last quarter comes from the next document. The order of ids is found on
narrow rows (id, digest, length), range partitioned, with one row per partition to link the ends; the texts are shuffled
once, and one more shuffle carries the next text's piece and sketch. No group is larger than one document.

A null text is empty; two empty sets resemble each other fully, an empty and another one not at all. A null id comes last
in order. Rows equal in id and text count as one document and all get its result; equal ids with different texts follow
each other by digest. A single document is its own next one. An empty table gives an empty result. `add_fingerprint`
replaces a column of the name it makes; `edited` returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SIZE, WIDTH = 128, 5
HEX = 16  # digits of one hash
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(word_list: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles, as hex digits, from an array of words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(word_list) - (width - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(word_list, i, width), " ").cast("binary")), 1, HEX))
    return F.when(F.size(word_list) > 0, hashes).otherwise(F.array().cast("array<string>"))


def smallest(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def pack(hashes: Column) -> Column:
    return F.unhex(F.array_join(hashes, ""))


def unpack(sketch: Column) -> Column:
    starts = F.sequence(F.lit(1), F.octet_length(sketch), F.lit(HEX // 2))
    return F.when(F.octet_length(sketch) > 0, F.transform(starts, lambda i: F.hex(F.substring(sketch, i, HEX // 2)))).otherwise(F.array().cast("array<string>"))


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """docs with the packed sketch of `text` as column `name`. No shuffle."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    inner = docs.select(F.struct(*kept).alias("row") if kept else F.lit(0).alias("row"), words(F.col(f"`{text}`")).alias("words"))
    made = inner.select("row", pack(smallest(shingle_hashes(F.col("words"), width), size)).alias("made"))
    return made.select(*([F.col("row").getField(c).alias(c) for c in docs.columns if c != name]), F.col("made").alias(name))


def resemblance(one: Column, other: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity from two columns of unpacked hashes."""
    union = F.slice(F.sort_array(F.array_union(one, other)), 1, size)
    both = F.array_intersect(F.array_intersect(one, other), union)
    return F.when(F.size(union) > 0, F.size(both) / F.size(union)).otherwise(F.lit(1.0))


def containment(one: Column, other: Column, size: int = SIZE) -> Column:
    """Estimated share of one's shingles that the other has, from two columns of unpacked hashes."""
    last = F.when(F.size(other) < size, F.lit("g")).otherwise(F.array_max(other))  # a sketch that holds all hashes has no end
    seen = F.filter(one, lambda x: x <= last)
    return F.when(F.size(one) == 0, F.lit(1.0)).when(F.size(seen) > 0, F.size(F.array_intersect(seen, other)) / F.size(seen)).otherwise(F.lit(0.0))


def distinct_shingles(hashes: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below `size`."""
    # the leading 52 bits as a share of their range
    end = F.conv(F.substring(F.array_max(hashes), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))
    return F.when(F.size(hashes) < size, F.size(hashes).cast("double")).otherwise(F.lit(size - 1.0) / end)


def merge(sketches: DataFrame, by: list[str], name: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """One packed sketch for each value of `by` (nulls are a value), from the sketches of its rows.

    Hashes are made distinct before the first shuffle, which spreads a hot group by hash; every task then hands on at
    most `size` hashes of a group (the rank limit is applied before the shuffle).
    """
    parts = [F.col(f"`{c}`").alias(f"by{n}") for n, c in enumerate(by)]
    names = [f"by{n}" for n in range(len(by))]
    rows = sketches.select(*parts, F.explode_outer(unpack(F.col(f"`{name}`"))).alias("hash")).distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy(F.col("hash").asc_nulls_last()))).where(F.col("rank") <= size)
    out = ranked.groupBy(*names).agg(pack(F.sort_array(F.collect_list("hash"))).alias("made"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], F.col("made").alias(name))


def followers(keys: DataFrame) -> DataFrame:
    """From distinct (key, id, n, copies): for each key the row before it in order of id, as before_*; the first has the last."""
    order = [F.col("id").asc_nulls_last(), F.col("key").asc()]
    row = F.struct("key", "id", "n", "copies")
    ranged = cut_lineage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = ranged.select("key", "part", F.lag(row).over(Window.partitionBy("part").orderBy(*order)).alias("before"))
    # one row for each partition of the range shuffle goes through the windows without a partition
    ends = ranged.groupBy("part").agg(F.max_by(row, F.struct(F.col("id").isNull(), "id", "key")).alias("end"))
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(Window.orderBy("part")), F.last("end").over(everything)).alias("end"))
    return inside.join(ends, "part").select("key", F.coalesce("before", "end").alias("before")).select("key", "before.*").toDF(
        "next_key", "before_key", "before_id", "before_n", "before_copies")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Per document: its key, `n_chars`, sketch, the edited text's digest and sketch, and the next document's sketch.

    In the edited text the last floor(n_chars / share) code points are replaced by the first as many of the next one's.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the type of the id stays; its text and the digest of the body name the document
    named = docs.select(F.concat(F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit("")), F.lit(":"), F.md5(body.cast("binary"))).alias("key"),
                        F.col(f"`{key}`").alias("id"), body.alias("text"))
    keys = named.groupBy("key").agg(F.min("id").alias("id"), F.min(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    marked = add_fingerprint(named.select("key", "text"), "text", "own", size, width)
    texts = marked.groupBy("key").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    pieces = texts.join(followers(keys), F.col("key") == F.col("next_key")).select(
        F.col("before_key").alias("piece_key"), F.col("before_id").alias(key), F.col("before_n").alias("n"), F.col("before_copies").alias("copies"),
        F.substring("text", F.lit(1), F.floor(F.col("before_n") / share).cast("int")).alias("piece"), F.col("own").alias("next"))
    joined = texts.join(pieces, F.col("key") == F.col("piece_key"))
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / share)).cast("int"))
    changed = joined.select(F.col(f"`{key}`"), "n", "copies", "own", "next", F.concat(kept, "piece").alias("changed"))
    made = add_fingerprint(changed, "changed", "edited", size, width)
    # every row of a repeated document gets its result
    return made.select(F.col(f"`{key}`"), F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
                       F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"), F.col("next").alias("next_fingerprint"),
                       F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
