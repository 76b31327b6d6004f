import random

import pytest
from pyspark.sql import functions as F

from sedge.llm import common, neardup, queries
from tests.compare import connect, rows as comparable
from tests.llm.tables import components, docs, shingle_set


def check(spark, data, k=3, percent=85):
    got = {r.doc_id: r for r in neardup.groups(docs(spark, data), k, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == components(data, k, percent)
    assert all(r.n_shingles == len(shingle_set(dict(data)[i], k)) and r.kept == (i == r.component_id) for i, r in got.items())


def near(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_copies_near_copies_and_shared_passages(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(r.randint(30, 160))) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(70))
    texts = base + base[:20] + [near(t, r, n) for t in base[:30] for n in (1, 2, 4)] + [t + " " + passage for t in base[30:55]] + [base[0].upper()]
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_links_at_the_threshold(spark, k, percent):
    words = [f"w{i}" for i in range(400)]
    data = [(n, " ".join(words[: 400 - n])) for n in range(0, 140, 7)] + [(1000 + n, " ".join(words[n:])) for n in range(0, 140, 9)]
    check(spark, data, k, percent)


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one two three"), (8, "word " * 60_000), (9, "word " * 59_999), (10, " a b c"), (11, "é\x1cü x y")])
    odd = docs(spark, [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "x y z"), (4, "x y z")]).withColumns({"id": F.lit(0), "regs": F.lit("x"), "label": F.lit(1)})
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.groups(odd, 3, 85).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (4, 3, False), (None, None, True), (None, None, True)]
    assert neardup.groups(docs(spark, []), 3, 85).collect() == []


def test_a_large_group_is_one_component(spark):
    r = random.Random(1)
    base = " ".join(f"w{i}" for i in range(120))
    data = [(i, base if i % 3 else near(base, r, 1)) for i in range(600)] + [(1000 + i, f"other text number {i} of its own kind") for i in range(50)]
    got = neardup.groups(docs(spark, data), 3, 85).filter("doc_id < 1000").select("component_id").distinct().count()
    assert got == 1


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    df = neardup.op8_neardup(spark, sf)
    result = connect(sf).execute(queries.oracle_sql()["op8_neardup"])
    assert comparable(df.columns, df.collect()) == comparable([d[0] for d in result.description], result.fetchall())
    assert df.count() == common.table(spark, sf, "documents").count()


def test_a_bucket_with_very_many_members_is_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 1000)
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("key"), F.lit(100_000).cast("long").alias("n"), "id").unionByName(spark.createDataFrame([(1, 2, 5), (1, 2, 6)], "key long, n long, id long"))
    ones = rows.groupBy("key").agg(F.min("id").alias("h"), F.max("n").alias("_n"))
    assert rows.count() == neardup.met(rows, ones).count() == 100_002
    parts = neardup.met(rows, ones).select("key", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 1000)).alias("p")).groupBy("key", "p").count().agg(F.max("count")).first()[0]
    assert parts < 1_300


def test_hot_buckets_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(90)) for _ in range(6)]
    check(spark, list(enumerate(base + [near(b, r, n) for b in base for n in (1, 1, 2, 3, 5)])))


def test_components_stop(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
