"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves; CENTROIDS centroids of either half, fitted
on a bounded sample, make CENTROIDS^2 cells, and every vector is listed in the cell of its nearest
pair. A query walks the pairs by ascending sum of its two distances with a heap until the cells it
has met hold a share of all vectors; these entries are ranked by exact cosine. The share is measured:
PROBES queries are answered by brute force over all rows, in one pass, and the share is what the
walks need to meet TARGET of their neighbours.

Cells are laid out in blocks of about BLOCK rows: small cells share a block, a large one is split,
and the queries that visit a block come in chunks of about QUERIES. A task meets one block and one
chunk, so neither a crowded cell nor a common query is ever in one task as a whole. An entry is sent
once for each chunk, a query once for each block with its last distance instead of its cells; up to
QUERIES queries that is once for every entry.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

CENTROIDS, SAMPLE, TURNS, SEED = 64, 8192, 15, 5
PROBES, TARGET, BLOCK, QUERIES, SLICE = 200, 0.94, 16_384, 16_384, 128
MARGIN = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, zero or with a null or non-finite component."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def kmeans(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]].copy()
    for _ in range(TURNS):
        near = squared(x, c).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:] if x.shape[1] > 1 else np.zeros((len(x), 1))


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
    """Cells by ascending d1[i] + d2[j] until they hold enough entries; sizes is by cell i * K2 + j."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    k1, k2 = len(s1), len(s2)
    heap, met, got, have = [(s1[0] + s2[0], 0, 0)], np.zeros(k1, dtype=int), [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k2 + int(o2[j])
        met[i] = j + 1
        if sizes[cell]:
            got.append(cell)
            have += int(sizes[cell])
        if j + 1 < k2 and (i == 0 or met[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < k1 and met[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return got


def layout(sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    at, filled = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > block:
            at += filled > 0
            first[cell], parts[cell] = at, -(-n // block)
            at, filled = at + int(parts[cell]), 0
        else:
            if filled + n > block:
                at, filled = at + 1, 0
            first[cell], filled = at, filled + n
    return first, parts


def best(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
    """Per query the k best allowed rows by cosine, ties to the smaller id; yields (query, rows, scores)."""
    qn, rn = np.sqrt((queries * queries).sum(1)), np.sqrt((rows * rows).sum(1))
    near = (queries @ rows.T) / np.outer(qn, rn)
    near[~allowed] = -np.inf
    m = min(k, near.shape[1])
    floor = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
    for q in range(len(queries)):
        pick = np.flatnonzero((near[q] >= floor[q] - MARGIN) & allowed[q])
        if len(pick):
            exact = (rows[pick] * queries[q]).sum(1) / (rn[pick] * qn[q])  # row by row, so equal vectors score the same
            order = np.lexsort((ids[pick], -exact))[:k]
            yield q, pick[order], exact[order]


def needed(vectors: np.ndarray, cells: list[list[int]], books: list[np.ndarray], sizes: np.ndarray, target: float) -> float:
    """The share of all entries that walks from these vectors meet before `target` of the cells given
    for each of them (of its true neighbours) are behind them."""
    shares: list[float] = []
    d = [squared(h, c) for h, c in zip(halves(vectors), books)]
    for i, wanted in enumerate(cells):
        met, have = {}, 0
        for cell in walk(d[0][i], d[1][i], sizes, float("inf")):
            have += int(sizes[cell])
            met[cell] = have
        shares += [met[c] for c in wanted]
    return float(np.quantile(shares, target, method="higher")) / int(sizes.sum()) if shares else 1.0


def search(vectors: DataFrame, is_query: Column, k: int = 5, share: float | None = None, centroids: int = CENTROIDS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows that the index finds for each query.

    vectors has vec_id and embedding; is_query says which of its rows are queries (all rows of a
    vec_id, or none). share: which part of all entries a walk meets; None measures it. Every usable row
    is listed and may be found by any query but that of its own vec_id. Nearness is the cosine in
    double precision on the original vectors; ties go to the smaller vec_id. Vectors that are null,
    zero or hold a null or non-finite component take no part, nor do rows without vec_id or of
    another dimension than most of the sample. Rows that repeat a vec_id are candidates each, and
    one query, with the smallest of their vectors. Other columns do not matter. An empty table gives
    an empty table.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = vectors.schema["embedding"].dataType.simpleString()
    held = held if held == "array<float>" else "array<double>"
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sample = [r[0] for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").toLocalIterator()]
    if not sample:
        return empty
    widths, counts = np.unique([len(v) for v in sample], return_counts=True)
    width = int(widths[counts.argmax()])
    books = [kmeans(h, centroids) for h in halves(np.array([v for v in sample if len(v) == width], dtype=float))]
    k2 = len(books[1])
    whole = whole.filter(F.size("vector") == width)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                near = [squared(h, c).argmin(1) for h, c in zip(halves(matrix(batch.column("vector"))), books)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((near[0] * k2 + near[1]).astype(np.int32))], names=[*batch.schema.names, "cell"])

    listed = whole.mapInArrow(assign, f"vec_id long, vector {held}, asks boolean, cell int")
    sizes = np.zeros(len(books[0]) * k2, dtype=np.int64)
    for r in listed.groupBy("cell").count().collect():  # a row for each cell at most
        sizes[r["cell"]] = r["count"]
    total = int(sizes.sum())
    first, parts = layout(sizes)
    asked = whole.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("own"))

    if share is None:
        probes = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect()
        if not probes:
            return empty
        probe_ids, probe_vectors = np.array([r.vec_id for r in probes]), np.array([r.vector for r in probes], dtype=float)

        def exact(batches):
            have: list[list] = [[] for _ in probes]
            for batch in batches:
                ids, cell, x = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy(zero_copy_only=False), matrix(batch.column("vector"))
                for i, picked, scores in best(probe_vectors, x, probe_ids[:, None] != ids[None, :], ids, k):
                    have[i] = sorted([*have[i], *zip((-scores).tolist(), ids[picked].tolist(), cell[picked].tolist())])[:k]
            rows = [(i, -s, v, c) for i, got in enumerate(have) for s, v, c in got]
            cols = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["probe", "score", "vec_id", "cell"])

        true = listed.select("vec_id", "vector", "cell").mapInArrow(exact, "probe int, score double, vec_id long, cell int")
        top = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
        cells: list[list[int]] = [[] for _ in probes]
        for r in true.withColumn("n", top).filter(F.col("n") <= k).collect():  # k rows for each probe at most
            cells[r.probe].append(r.cell)
        share = needed(probe_vectors, cells, books, sizes, TARGET)

    def place(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            part = batch.column("salt").to_numpy(zero_copy_only=False) % parts[cell]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), batch.column("cell"), pa.array(first[cell] + part)], names=["vec_id", "vector", "cell", "block"])

    # equal rows are apart in a cell that is split: the salt also hashes where they were read
    salt = F.shiftrightunsigned(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(SEED)), 1)
    entries = common.stash(listed.select("vec_id", "vector", "cell", salt.alias("salt")).mapInArrow(place, f"vec_id long, vector {held}, cell int, block long"), "entries")

    def visit(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            if batch.num_rows:
                v = matrix(batch.column("vector"))
                d = [squared(h, c) for h, c in zip(halves(v), books)]
                own = batch.column("own").to_pylist()
                for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                    met = np.array(walk(d[0][i], d[1][i], sizes, max(k + own[i], share * total)))
                    last = float((d[0][i][met // k2] + d[1][i][met % k2]).max())
                    blocks = np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in met])).tolist()
                    for column, x in zip(out, ([vec_id] * len(blocks), [i] * len(blocks), blocks, [last] * len(blocks))):
                        column += x
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column("vector").take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["query_id", "query", "block", "last"])

    visits = common.stash(asked.mapInArrow(visit, f"query_id long, query {held}, block long, last double"), "visits")
    chunks = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
    left = entries.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop("chunks")

    def rank(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], []]
        if len(rows) and len(queries):
            ids, cell = rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
            x = np.stack(rows["vector"].to_list()).astype(float)
            for at in range(0, len(queries), SLICE):
                some = queries.iloc[at : at + SLICE]
                q, asker, last = np.stack(some["query"].to_list()).astype(float), some["query_id"].to_numpy(), some["last"].to_numpy()
                d = [squared(h, c) for h, c in zip(halves(q), books)]
                allowed = d[0][:, cell // k2] + d[1][:, cell % k2] <= last[:, None] * (1 + MARGIN) + MARGIN
                allowed &= asker[:, None] != ids[None, :]
                for i, picked, scores in best(q, x, allowed, ids, k):
                    out[0] += [asker[i]] * len(picked)
                    out[1] += ids[picked].tolist()
                    out[2] += scores.tolist()
        return pd.DataFrame({"query_id": np.array(out[0], dtype=np.int64), "vec_id": np.array(out[1], dtype=np.int64), "score": np.array(out[2], dtype=np.float64)})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(rank, "query_id long, vec_id long, score double")
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place_of).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
