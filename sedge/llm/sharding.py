"""Sharding by a two-pass external shuffle, in DataFrame functions.

Pass one scatters the records by seeded hashes: the shard follows from doc_id and the number of
shards alone (rendezvous hashing: the shard whose hash with the id is largest, so one more shard
takes rows only into itself), and inside a shard the record goes to one of so many buckets, by the
shard's own size, that a bucket fits into memory. Rows that repeat an id and a text so often that they
would fill a bucket are numbered and scattered by their number too. Each bucket is one partition.
Pass two shuffles it by Fisher-Yates (Spark's seeded shuffle of an array) and lays the buckets of a
shard one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

SHARDS, BUCKET_BYTES, SEED = 16, 16 << 20, 42
#: What a row takes in memory beside its text.
ROW_BYTES = 64
#: Up to so many buckets (a table of 16 TB by the defaults) their places, 24 bytes each, are broadcast.
BROADCAST_BUCKETS = 1_000_000


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    weighed = [F.struct(F.xxhash64(doc_id, F.lit(s), F.lit(seed)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*weighed))["s"]


def spread(docs: DataFrame, crc: Column, bytes_of: Column, bucket_bytes: int) -> DataFrame:
    """docs with _salt: 0, but a number from 0 on for rows that repeat doc_id and text for more than a bucket.

    Such rows are counted where they are equal in all columns, and laid out again from the count, so
    no task gathers them and a task that runs again gives the same numbers.
    """
    record = docs.columns
    plain = docs.withColumns({"_crc": crc, "_salt": F.lit(0).cast("long")})
    hot = common.stash(docs.groupBy("doc_id", crc.alias("_crc")).agg(F.sum(bytes_of).alias("_bytes")).filter(F.col("_bytes") > bucket_bytes).select(F.col("doc_id").alias("_id"), F.col("_crc").alias("_hot")), "hot-rows")
    if hot.isEmpty():
        return plain
    among = plain["doc_id"].eqNullSafe(hot["_id"]) & (plain["_crc"] == hot["_hot"])
    counted = plain.join(hot, among, "left_semi").groupBy(*[f"`{c}`" for c in record], "_crc").agg(F.count("*").alias("_n"))
    numbered = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    return plain.join(hot, among, "left_anti").unionByName(numbered)


def scattered(docs: DataFrame, shards: int, bucket_bytes: int, seed: int) -> tuple[DataFrame, list[int], int]:
    """_row and _bucket of each row, the first bucket of each shard, and how many buckets there are."""
    bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    shard = shard_of(F.col("doc_id"), shards, seed)
    held = dict(docs.groupBy(shard.alias("s")).agg(F.sum(bytes_of)).collect())  # a row for each shard at most
    counts = [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]
    firsts = [sum(counts[:s]) for s in range(shards)]
    of = lambda numbers: F.get(F.array(*[F.lit(n).cast("int") for n in numbers]), "shard")
    salted = spread(docs, crc, bytes_of, bucket_bytes)
    placed = salted.select(F.struct(*docs.columns).alias("_row"), shard.alias("shard"), F.xxhash64("doc_id", "_crc", "_salt", F.lit(seed + 1)).alias("_h"))
    return placed.select("_row", (of(firsts) + F.pmod("_h", of(counts))).cast("int").alias("_bucket")), firsts, sum(counts)


def sharded(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (0, 1, ... in each shard, in random order).

    Columns of docs with these names are replaced, all others pass through. A null text has no
    bytes; a null doc_id is a key like any other. Rows that repeat a doc_id share its shard, however
    many they are, but not a bucket. An empty table gives an empty table.
    """
    docs = common.without(docs, "shard", "slot")
    names = docs.columns
    record = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)]
    placed, firsts, buckets = scattered(docs.toDF(*record), shards, bucket_bytes, seed)
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    shard_at = F.array_max(F.transform(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for s, n in enumerate(firsts)]), lambda x: F.when(x["n"] <= F.col("_bucket"), x["s"])))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("shard", shard_at).select("_bucket", "shard", before.alias("_before"))
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets
    whole = placed.repartitionById(buckets, "_bucket").groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    order = F.array_sort(F.transform("_rows", lambda r: F.struct(r["doc_id"].alias("id"), F.xxhash64(r["text"]).alias("t"), r.alias("r"))), lambda a, b: F.when(a["id"].eqNullSafe(b["id"]), F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)).when(a["id"].isNull() | (a["id"] < b["id"]), -1).otherwise(1))
    mixed = whole.select("_bucket", F.shuffle(order, F.lit(seed)).alias("_rows"))
    laid = mixed.join(offsets, "_bucket").select("shard", "_before", F.posexplode("_rows").alias("_at", "_row"))
    return laid.select(*[F.col("_row.r")[c].alias(c) for c in record], "shard", (F.col("_before") + F.col("_at")).alias("slot")).toDF(*names, "shard", "slot")


def write(docs: DataFrame, path: str, **how) -> None:
    """Writes docs as Parquet, a folder for each shard, each file in order of slots."""
    out = sharded(docs, **how)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
