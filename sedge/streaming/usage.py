"""Uses and episodes as streams: windowed counts, a running score for each artifact, upserts.

These go beyond batch: each has a batch twin among the queries, which tests compare with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

USE = "event_id long, artifact long, success boolean, at timestamp"


def read(spark: SparkSession, folder: str, schema: str = USE, per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(uses: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, artifact, uses, wins of tumbling (or sliding) windows; rows later than `late` behind
    the newest are dropped."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    counts = uses.withWatermark("at", late).groupBy(window.alias("w"), "artifact").agg(F.count("*").alias("uses"), F.sum(F.col("success").cast("long")).alias("wins"))
    return counts.select(F.col("w.start").alias("start"), "artifact", "uses", "wins")


def sessions(uses: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    counts = uses.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "artifact").agg(F.count("*").alias("uses"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "artifact", "uses")


def scores(uses: DataFrame) -> DataFrame:
    """artifact, uses, wins, roi after each batch that uses an artifact. The state of an artifact
    is two counters, however many uses it has had."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, won = state.get if state.exists else (0, 0)
        for b in batches:
            n, won = n + len(b), won + int(b["success"].sum())
        state.update((n, won))
        score = min(1.0, max(0.0, 0.7 * (won + 1) / (n + 2) + 0.3 * min(n / 5, 1.0)))
        yield pd.DataFrame({"artifact": [key[0]], "uses": [n], "wins": [won], "roi": [score]})

    return uses.groupBy("artifact").applyInPandasWithState(step, "artifact long, uses long, wins long, roi double", "uses long, wins long", "update", GroupStateTimeout.NoTimeout)


def newest(rows: DataFrame, key: str = "artifact", order: tuple[str, ...] = ("uses",)) -> DataFrame:
    """The row of each key that is the last by order, and then by all its columns."""
    names = [c for c in rows.columns if c != key]
    last = F.struct(*order, *[c for c in names if c not in order])
    return rows.groupBy(key).agg(F.max(last).alias("r")).select(*[key if c == key else f"r.{c}" for c in rows.columns])


def upserts(changes: DataFrame, folder: str, checkpoint: str, key: str = "artifact", order: tuple[str, ...] = ("uses",)):
    """Starts a query that keeps the newest row of each key, by order, in numbered tables of the
    folder, each written whole before the next; a batch that runs again after a failure writes the
    same one. An older row that arrives late does not replace a newer one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            old = spark.read.parquet(f"{folder}/v{number - 1}")
            rows = old.unionByName(batch.select(*old.columns))
        newest(rows, key, order).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
