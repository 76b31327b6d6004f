"""Operators that no registered query shows: stored indexes, caches, state, file sinks."""

import os
import stat

from pyspark.sql import functions as F

from sedge.engine import USE, Store
from sedge.operators import graph, monorepo, search, sinks, skeleton
from sedge.sources.adapters import Tables
from tests.conftest import SF


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    symbols = Tables(spark, SF).symbols()
    search.write_index(symbols, str(tmp_path))
    post, lens = spark.read.parquet(str(tmp_path / "postings")), spark.read.parquet(str(tmp_path / "lengths"))
    for query in ("red widget", "economy_brass x", "brand"):
        fresh = search.bm25(search.postings(symbols), search.lengths(symbols), query).collect()
        assert search.bm25(post, lens, query).collect() == fresh
    assert "StringStartsWith(term" in search.bm25(post, lens, "wid")._jdf.queryExecution().executedPlan().toString()


def test_search_without_words_or_hits(spark):
    symbols = Tables(spark, SF).symbols()
    assert search.search(symbols, "  ").count() == 0
    assert search.search(symbols, "!@#$%").count() == 0
    assert search.search(symbols, "zzzzzz").count() == 0
    assert search.search(symbols, "idge").count() == search.find(symbols, "idge", limit=20).count()


def test_accents_and_phrases(spark):
    rows = spark.createDataFrame([(1, "Créer_Élément"), (2, "process_payment"), (3, "payment_process"), (4, "processor"), (5, "x")], "id long, name string")
    post, lens = search.postings(rows, {"name": 10}), search.lengths(rows, {"name": 10})
    hits = lambda q: [r.id for r in search.bm25(post, lens, q).collect()]
    assert hits("creer") == [1] and hits("process_pay") == [2] and set(hits("process")) == {2, 3, 4} and hits("x") == [5]


def test_only_new_files_are_folded(spark):
    files = spark.createDataFrame([("a.py", 1.0, None, "def f():\n    x = 1\n    return x\n", "python"), ("b.py", 1.0, "g", "def g():\n    y = 2\n    return y\n", "python")], "path string, mtime double, focus string, text string, language string")
    empty = spark.createDataFrame([], "key string, skeleton string, tokens int, tier int, warning string")
    out, cache = skeleton.cached(files, empty)
    assert {r.path: r.skeleton for r in out.collect()} == {"a.py": "def f():\n    ... [L2-L3]", "b.py": "def g():\n    y = 2\n    return y"}
    again, grown = skeleton.cached(files.withColumn("text", F.lit("never read")), spark.createDataFrame(cache.collect(), cache.schema))
    assert grown.count() == 2 and {r.skeleton for r in again.collect()} == {r.skeleton for r in out.collect()}


def test_state_as_json(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/state")
    assert store.read("uses", USE).count() == 0
    store.append("uses", [("a", True, 1.0), ("b", False, 2.0)], USE)
    store.export("uses", USE, str(tmp_path / "json"))
    (tmp_path / "json" / "more.json").write_text("{broken\n")
    other = Store(spark, f"file://{tmp_path}/other")
    other.load("uses", USE, str(tmp_path / "json"))
    assert sorted(r.id for r in other.read("uses", USE).collect() if r.id) == ["a", "b"]


def test_files_keep_their_mode_and_time(tmp_path):
    path = tmp_path / "deep/x.md"
    assert sinks.write_if_changed(path, "a") and stat.S_IMODE(path.stat().st_mode) == 0o644
    os.chmod(path, 0o600)
    before = path.stat().st_mtime_ns
    assert not sinks.write_if_changed(path, "a") and path.stat().st_mtime_ns == before
    assert sinks.write_if_changed(path, "b") and stat.S_IMODE(path.stat().st_mode) == 0o600
    assert [p.name for p in path.parent.iterdir()] == ["x.md"]


def test_files_outside_packages_go_to_the_fallback(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), ("ab/c.py",)], "path string")
    folders = spark.createDataFrame([("a",), ("a/b",)], "package string")
    assert {r.path: r.package for r in monorepo.assign(files, folders, "root").collect()} == {"a/b/c.py": "a/b", "a/x.py": "a", "z.py": "root", "ab/c.py": "root"}


def test_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "a"), ("b", "d"), ("c", "b"), ("d", "c")], "dep string, consumer string")
    tests = spark.createDataFrame([("none", True)], "v string, is_test boolean")
    got = {r.v: r.level for r in graph.walk(edges, tests, spark.createDataFrame([("a",)], "v string"), 5).collect()}
    assert got == {"c": 1, "b": 2, "d": 3}
