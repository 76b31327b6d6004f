"""Document fingerprints: threshold-scaled sketches in DataFrame functions.

A sketch holds every hash of the document's WORDS-word shingles that lies in the lowest 1/SCALE of
the 64-bit range (and, where none does, the smallest hash alone, so that only texts without words
have an empty sketch). The threshold is the same for every document, so the sketch of a union is
the union of sketches, and the share of one document's sketch that is in another's estimates how
much of it the other contains, however unequal their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

WORDS, SCALE = 5, 4


def _hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order."""
    return F.transform(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(h: Column, words: int) -> Column:
    """Hashes of the runs of so many words; of all words if there are fewer. h must be a column that
    is projected before, or it would be computed anew for each shingle."""
    several = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    return F.when(F.size(h) >= words, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """df with the sketch of its column text (null: empty) as `out array<bigint>`, sorted."""
    limit = -(1 << 63) + (1 << 64) // scale
    df = df.withColumn("_h", _hashes(F.coalesce(F.col(text), F.lit("")))).withColumn("_s", _shingles(F.col("_h"), words)).drop("_h")
    df = df.withColumn("_k", F.filter("_s", lambda x: x < F.lit(limit)) if scale > 1 else F.col("_s"))
    kept = F.when((F.size("_k") == 0) & (F.size("_s") > 0), F.array(F.array_min("_s"))).otherwise(F.array_sort(F.array_distinct("_k")))
    return df.withColumn(out, kept).drop("_s", "_k")


def encoded(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, in ascending order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 if only one is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < F.lit(-(1 << 63) + (1 << 64) // scale))
    return F.when((F.size(below) == 0) & (F.size(both) > 0), F.slice(both, 1, 1)).otherwise(below)


def ring(keys: DataFrame) -> DataFrame:
    """k, next_k: each distinct key with the next smaller one, the smallest with the largest.

    Only keys are sorted, by ranges; each range finds the next key of its last one from the table of
    the ranges' first keys, which has a row for each partition.
    """
    parts = common.stash(keys.select("k").distinct().repartitionByRange(F.col("k").desc()).select("k", F.spark_partition_id().alias("part")), "ring")
    heads = parts.groupBy("part").agg(F.max("k").alias("head"))
    by_part = Window.orderBy("part")
    heads = heads.withColumn("follows", F.lead("head").over(by_part)).withColumn("first", F.first("head").over(by_part)).select("part", F.coalesce("follows", "first").alias("after"))
    inside = parts.withColumn("_n", F.lead("k").over(Window.partitionBy("part").orderBy(F.col("k").desc())))
    return inside.join(heads, "part").select("k", F.coalesce("_n", "after").alias("next_k"))


#: A cell holds so many neighbouring ids (as a power of two) if they are dense; the ids in the last
#: of 2^EDGE parts of a cell are also sent to the next cell; up to so many other pairs are broadcast.
CELL, EDGE, FEW = 8, 5, 10_000


def _beside(docs: DataFrame, order: DataFrame) -> tuple[DataFrame, Window]:
    """Rows and a window over them in which each of docs (k, text and more; each k once) is followed
    by its next one; kind is 0 on docs' own rows. The texts are shuffled once.

    Neighbouring ids share a cell, which is a hash key of one exchange; a window over the cell finds
    the next row. Ids at the edge of a cell are sent to the cell above as well. Pairs that are still
    apart (ids with gaps, the last and the first) are known from the ids alone; their donors get the
    asker's place and go through the same exchange.
    """
    gap = F.when(F.col("k") > F.col("next_k"), F.col("k").cast("double") - F.col("next_k").cast("double"))
    least = order.agg(F.min(gap)).first()[0] or 1.0
    bits = min(CELL + max(0, int(least).bit_length() - 1), 62)
    cell = lambda k: F.shiftright(k, bits)
    at_edge = lambda k: F.shiftright(k, bits - EDGE).bitwiseAND(F.lit((1 << EDGE) - 1)) == (1 << EDGE) - 1
    near = (F.col("next_k") < F.col("k")) & ((cell(F.col("next_k")) == cell(F.col("k"))) | (at_edge(F.col("next_k")) & (cell(F.col("next_k")) + 1 == cell(F.col("k")))))
    apart = order.filter(~near).select(F.col("next_k").alias("k"), F.col("k").alias("asker"))
    if apart.count() <= FEW:
        apart = F.broadcast(apart)
    more = [c for c in docs.columns if c not in ("k", "text")]
    empty = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in more]
    own = docs.select(cell(F.col("k")).alias("cell"), "k", F.lit(0).alias("kind"), "text", *more)
    edge = docs.filter(at_edge(F.col("k"))).select((cell(F.col("k")) + 1).alias("cell"), "k", F.lit(1).alias("kind"), "text", *empty)
    sent = docs.select("k", "text").join(apart, "k").select(cell(F.col("asker")).alias("cell"), F.col("asker").alias("k"), F.lit(1).alias("kind"), "text", *empty)
    dealt = own.unionByName(edge).unionByName(sent)
    following = Window.partitionBy("cell").orderBy(F.desc("k"), "kind")
    return dealt, following


def fingerprinted(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each row of docs (doc_id, text) with its own sketch, its edited text and that text's sketch.

    Returns doc_id, n_chars, sketch, edited_text, edited_sketch, next_sketch. The edited text has the
    last half of the text (rounded down) replaced by as much of the start of the next document, in
    descending order of doc_id and after the last one the first. Null texts are empty; a null doc_id
    counts as the smallest. Rows that repeat a doc_id are all returned; where such a document is the
    next of another, its smallest text stands for it. Other columns do not matter. An empty table
    gives an empty table.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    order = common.stash(ring(docs.select("k")), "order")
    if docs.count() == order.count():
        dealt, following = _beside(docs, order)
        both = with_sketch(dealt, "text", "sketch", words, scale)
        both = both.withColumns({"next_text": F.lead("text").over(following), "next_sketch": F.lead("sketch").over(following)}).filter("kind = 0")
    else:
        both = _repeated(with_sketch(docs, "text", "sketch", words, scale), order)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "sketch", edited.alias("edited_text"), "next_sketch")
    return with_sketch(both, "edited_text", "edited_sketch", words, scale)


def _repeated(docs: DataFrame, order: DataFrame) -> DataFrame:
    """The same where ids repeat: one row of each id is the donor, and two joins on the id bring it
    to its asker. Joins on a hot id are split by the skew handling of adaptive execution."""
    donor = docs.groupBy("k").agg(F.min(F.struct("text", "sketch")).alias("d"))
    given = order.select(F.col("next_k").alias("k"), F.col("k").alias("asker")).join(donor, "k").select(F.col("asker").alias("k"), F.col("d.text").alias("next_text"), F.col("d.sketch").alias("next_sketch"))
    return docs.join(given, "k")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    found = fingerprinted(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        encoded(F.col("sketch")).alias("fingerprint"),
        encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
