import numpy as np
from pyspark.sql import functions as F

from sedge.llm import ann, common
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def exact(rows, asks, k=5):
    good = [(i, np.asarray(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if asks(q):
            near = sorted(((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, SF, "embeddings").collect()]
    want = exact(rows, lambda q: q % 50 == 0)
    found = ann.op9_nearest(spark, SF).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    true = {q: dict(exact(rows, lambda x, q=q: x == q, len(rows))[q]) for q in list(want)[:3]}
    assert all(abs(s - true[q][i]) < 1e-12 for q in true for i, s in got[q])


def test_all_cells_give_the_exact_answer(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=9).astype(np.float32).tolist(), 0) for i in range(300)]
    found = ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 7 == 0, share=1.0, centroids=8).collect()
    want = exact([x[:2] for x in rows], lambda q: q % 7 == 0)
    got = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in want.items()}


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (8, [0.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, KIND).withColumns({"cell": F.lit("x"), "vector": F.lit(1), "block": F.lit(2)})
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") == 0).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.0), (0, 4, 8, 0.0)]
    assert ann.search(spark.createDataFrame([], KIND), F.lit(True)).collect() == []
    assert ann.search(spark.createDataFrame([(3, None, 1)], KIND), F.lit(True)).collect() == []


def test_equal_vectors_are_split_into_blocks(spark, monkeypatch):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(700)]
    found = ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 100 == 0).collect()
    assert all(r.vec_id < 6 for r in found) and len(found) == 35


def test_walk_takes_pairs_in_order():
    d1, d2 = np.array([0.3, 0.1, 0.2]), np.array([0.5, 0.0])
    sizes = np.ones(6, dtype=int)
    assert ann.walk(d1, d2, sizes, 6) == [i * 2 + j for _, i, j in sorted((d1[i] + d2[j], i, j) for i in range(3) for j in range(2))]


def test_own_id_repeated_more_than_k_times(spark):
    rows = [(0, [1.0, 0.0], 0)] * 9 + [(i, [1.0, 0.01 * i], 0) for i in range(1, 40)]
    found = ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") == 0, share=0.0).collect()
    assert len(found) == 5 and all(r.vec_id != 0 for r in found)
    found = ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") == 0, share=1.0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_clustered_vectors_need_a_small_share():
    r = np.random.default_rng(3)
    centers = r.normal(size=(40, 16))
    x = np.concatenate([c + 0.01 * r.normal(size=(50, 16)) for c in centers])
    books = [ann.kmeans(h, 32) for h in ann.halves(x)]
    near = [ann.squared(h, c).argmin(1) for h, c in zip(ann.halves(x), books)]
    cell = near[0] * len(books[1]) + near[1]
    sizes = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    wanted = [[int(cell[j]) for j in range(i - i % 50, i - i % 50 + 50)] for i in range(0, 2000, 100)]
    assert ann.needed(x[::100], wanted, books, sizes, 0.94) < 0.2
    assert ann.needed(x[::100], wanted, books, sizes, 1.0) <= 1.0


def test_blocks_and_chunks_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 16)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist(), 0) for i in range(400)]
    found = ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 3 == 0, share=1.0, centroids=8).collect()
    want = exact([x[:2] for x in rows], lambda q: q % 3 == 0)
    got = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in want.items()}
