"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and in it one of the
    application. Where that is unset, a folder under the temporary folder for a local master (one
    machine), and an error for any other."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"file://{os.path.join(tempfile.gettempdir(), 'sedge-shared')}"
    return f"{configured.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes what stash wrote in this application; DataFrames that read it are of no use then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def held_out(doc_id: Column) -> Column:
    """True on the third of the ids that no fit may use; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Bounds of a fit: rows of each class, and code points of a text that may be fitted on.
FIT_PER_CLASS = 3000
FIT_MAX_CHARS = 20_000


def fit_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int = FIT_PER_CLASS, max_chars: int = FIT_MAX_CHARS) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of a bounded sample of labelled rows that are not held out.

    At most per_class rows of each class, those with the smallest hash of doc_id, and of
    those only texts of at most max_chars code points: 2 * per_class * max_chars code
    points reach the driver at most. Null texts, ids and labels take no part, nor do ids that
    are labelled both 0 and 1; of texts that repeat a doc_id the smallest is used. So the sample
    does not depend on the order or the partitions of the rows.
    """
    given = labels.select("doc_id", F.col(column).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = given.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_other")).filter("y = _other").select("doc_id", "y")
    picked = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.y) for r in rows.toLocalIterator())
    return [r[1] for r in got], [r[2] for r in got]


#: Rows, and bytes unless a row alone has more, that a worker turns into Python objects at a time.
SLICE, SLICE_BYTES = 256, 32 << 20


def slices(batches, rows: int = SLICE, most: int = SLICE_BYTES):
    """The batches in pieces of so many rows and bytes, so that long texts are not all held as objects at once."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            piece = batch.slice(start, rows)
            while piece.num_rows > 1 and piece.nbytes > most:
                piece = piece.slice(0, piece.num_rows // 2)
            start += piece.num_rows
            yield piece


class Cache(dict):
    """cache[key] is make(key), kept in two generations of at most `limit` short keys each."""

    def __init__(self, make, limit: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
