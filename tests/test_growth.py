"""What joins and aggregates make grows with their input, not with the pairs in it."""

from collections import Counter

from pyspark.sql import functions as F

from sedge.operators import memory, search


def most_rows(df, kind: str) -> int:
    """The most rows that an operator of this kind gave when df was collected."""

    def walk(node):
        name = node.nodeName()
        if kind in name and node.metrics().contains("numOutputRows"):
            yield node.metrics().apply("numOutputRows").value()
        inner = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if name.endswith("QueryStage") else None
        below = [node.children().apply(i) for i in range(node.children().size())] if inner is None else [inner]
        for child in below:
            yield from walk(child)

    return max(walk(df._jdf.queryExecution().executedPlan()), default=0)


def test_lessons_of_one_name_meet_once(spark):
    """lesson_dedup: many stored and incoming lessons share a name, others a scope and content."""
    said = F.concat(F.lit("c"), F.col("id") % 3)
    stored = spark.range(1000, 2000).select("id", (-F.col("id")).alias("seq"), F.when(F.col("id") % 2 == 0, "One ").otherwise(F.concat(F.lit("n"), "id")).alias("name"), F.lit("global").alias("scope"), said.alias("content"))
    new = spark.range(300).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "oNE").otherwise("other").alias("name"), F.lit("global").alias("scope"), F.when(F.col("id") % 3 == 1, "C1").otherwise("new").alias("content"))
    found = memory.matched(stored, new)
    got = {r.key: r.id for r in found.collect()}
    assert got == {k: 1998 if k % 3 == 0 else 1999 for k in range(300) if k % 3 < 2}
    assert 0 < most_rows(found, "Join") <= 300


def test_vocabulary_counts_ids_once(spark):
    """tokenize_postings: repeated and null ids, terms that repeat in a row and between rows of an id."""
    rows = [(1, "a b a", "x"), (1, "a c", None), (2, "b", "x x"), (None, "a d", "x"), (None, "d", ""), (3, "É-a", "y"), (1, "a b a", "x")]
    got = search.vocabulary(spark.createDataFrame(rows, "id long, name string, docstring string"), {"name": 1, "docstring": 1})
    said = [(col, t, r[0]) for r in rows for col, text in zip(("name", "docstring"), r[1:]) for t in (text or "").lower().replace("é", "e").replace("-", " ").split()]
    n, ids = Counter((c, t) for c, t, _ in said), Counter((c, t) for c, t, i in set(said) if i is not None)
    assert {(r.col, r.term): (r.n, r.docs) for r in got.collect()} == {k: (n[k], ids[k]) for k in n}
    assert got.dtypes == [("col", "string"), ("term", "string"), ("n", "bigint"), ("docs", "bigint")]


def test_vocabulary_holds_no_pairs_of_term_and_id(spark):
    made = F.concat_ws(" ", *[F.lit(f"term{i}") for i in range(30)])
    symbols = spark.range(2000).select("id", *[made.alias(c) for c in search.WEIGHTS])
    found = search.vocabulary(symbols)
    assert {(r.n, r.docs) for r in found.collect()} == {(2000, 2000)}
    assert 0 < most_rows(found, "Aggregate") <= 2 * 2000


def test_tokenize_postings_holds_no_pairs_of_term_and_id(spark):
    from sedge import plans
    from tests.conftest import SF

    found = plans.QUERIES["tokenize_postings"](spark, SF)
    found.collect()
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert 0 < most_rows(found, "Aggregate") <= 2 * parts
