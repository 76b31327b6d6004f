"""Properties that hold for any input, and the streaming twins of batch queries."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.functions import exprs as x
from sedge.operators import graph, memory, render, scan, sinks, skeleton
from sedge.sources.adapters import Tables
from sedge.streaming import usage
from tests.conftest import SF


def test_walk_levels_are_disjoint_and_end(spark):
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(120)], "dep long, consumer long").filter("dep <> consumer").distinct()
    tests = spark.createDataFrame([(i, i % 9 == 0) for i in range(40)], "v long, is_test boolean")
    found = graph.walk(edges, tests, spark.createDataFrame([(1,)], "v long"), 30).collect()
    assert len({f.v for f in found}) == len(found) and 1 not in {f.v for f in found}
    pairs, seen, frontier, want = {(e.dep, e.consumer) for e in edges.collect()}, {1}, {1}, {}
    for level in range(1, 31):
        new = {c for d, c in pairs if d in frontier} - seen
        want |= dict.fromkeys(new, level)
        seen |= new
        frontier = {v for v in new if v % 9}
    assert {f.v: f.level for f in found} == want


def test_evolve_keeps_at_most_the_capacity(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(i, r.choice([0.2, 0.5, 0.5, 0.8]), r.randrange(9)) for i in range(90)], "id long, roi double, last_us long")
    data = [(f.id, f.roi, f.last_us) for f in rows.collect()]
    for capacity, protect in ((10, 3), (3, 5), (200, 5), (5, 0)):
        alive = [d for d in data if d[1] >= 0.3]
        if len(alive) > capacity:
            kept = sorted(alive, key=lambda d: (-d[2], d[0]))[:protect]
            rest = sorted((d for d in alive if d not in kept), key=lambda d: (-d[1], -d[0]))
            alive = sorted(kept, key=lambda d: (-d[1], -d[0]))[:capacity] + rest[: max(0, capacity - protect)]
        got = {f.id for f in memory.evolve(rows, 0.3, capacity, protect).filter("not pruned").collect()}
        assert got == {d[0] for d in alive}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, n int")
    once = scan.upsert(old, new)
    assert sorted(map(tuple, scan.upsert(once, new).collect())) == sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_budget_is_never_exceeded(spark):
    lines = spark.createDataFrame([(g, i, "x" * (i * 7 % 40)) for g in range(3) for i in range(60)], "g int, i int, line string")
    for row in render.within_budget(lines, "line", 50, ["g"], F.col("i")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l")).collect():
        assert len("\n".join(p.line for p in row.l)) // 4 <= 50
        assert [p.i for p in row.l] == list(range(len(row.l)))


@given(st.text(alphabet="ab<s>/\n `", max_size=60))
@settings(max_examples=200, deadline=None)
def test_a_block_put_twice_is_put_once(text):
    once = sinks.put_block(text, "<s>", "</s>", "body", "## H")
    assert sinks.put_block(once, "<s>", "</s>", "body", "## H") == once and "<s>\nbody\n</s>" in once


def test_block_column_equals_the_driver(spark):
    r = random.Random(9)
    parts = ["<s>", "</s>", "\n<s>\n", "\n</s>\n", "text", "\n", "  <s>  \n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", sinks.injected(F.col("t"), "<s>", "</s>", "new", "## H").alias("o")).collect()
    assert all(g.o == sinks.put_block(g.t, "<s>", "</s>", "new", "## H") for g in got)


@given(st.lists(st.sampled_from(["def f(a):", "    return 1", "class A:", "    def g(self):", '        """Doc."""', "        x = 1", "    pass", "", "@deco", "# note", "def broken("]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_folding_never_fails_and_python_stays_python(lines):
    code = "\n".join(lines)
    for focus in (None, "g", "A.g", "f()"):
        out, tier, _ = skeleton.fold(code, "python", focus, 40)
        assert isinstance(out, str) and 1 <= tier <= 4
    skeleton.fold(code.replace(":", " {"), "typescript", "g", 40)


def test_focus_is_kept_verbatim():
    code = "class A:\n  @deco\n  def f(self):\n    x = 1  # why\n\n    return x\n    # tail\n  def g(self):\n    return 2\n"
    out, _, warning = skeleton.fold(code, "python", "A.f")
    assert "    @deco\n    def f(self):\n      x = 1  # why\n\n      return x\n      # tail" in out and "... [L9-L9]" in out and warning is None
    assert "not found" in skeleton.fold(code, "python", "nothing")[2]
    go = "func (s *Store) Get(k string) string {\n\treturn k\n}\nfunc Put() {\n\tx()\n}\n"
    assert skeleton.fold(go, "go", "Store.Get")[0] == "func (s *Store) Get(k string) string {\n\treturn k\n}\nfunc Put() {\n    ... [L5-L5]\n}\n"
    ts = "const f = (a) => {\n  return a;\n};\nconst g = async x => {\n  if (x) { y(); }\n};\nfunction h({ a, b }) {\n}\n"
    assert skeleton.fold(ts, "typescript")[0] == "const f = (a) => {\n    ... [L2-L2]\n};\nconst g = async x => {\n    ... [L5-L5]\n};\nfunction h({ a, b }) {\n}\n"


def test_joined_paths(spark):
    import posixpath

    paths = ["a/../b", "./a/b", "a/./b//c", "../a", "a/../../b", "../../x", "a/b/../../../c"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", x.joined_path(F.col("p")).alias("o")).collect()
    assert all(g.o == posixpath.normpath(g.p) for g in got)


def _uses(spark):
    return Tables(spark, SF).usage().select("event_id", "artifact", "success", F.col("ts").cast("timestamp").alias("at"))


def _stream(spark, tmp_path, parts=3):
    _uses(spark).repartitionByRange(parts, "at").sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    return usage.read(spark, str(tmp_path / "in"), per_trigger=1)


def _all(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def test_windowed_counts_equal_batch(spark, tmp_path):
    got = _all(spark, usage.windowed(_stream(spark, tmp_path), late="60 days"), "update", "tumbling").groupBy("start", "artifact").agg(F.max("uses").alias("uses"))
    want = _uses(spark).groupBy(F.window("at", "1 day").alias("w"), "artifact").agg(F.count("*").alias("uses")).select("w.start", "artifact", "uses")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_running_scores_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "table")
    usage.upserts(usage.scores(_stream(spark, tmp_path)), folder, str(tmp_path / "cp")).awaitTermination(300)
    last = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name[1:]))
    got = {r.artifact: (r.uses, r.wins, round(r.roi, 9)) for r in spark.read.parquet(str(last)).collect()}
    want = {r.id: (r.uses, r.wins, round(r.roi, 9)) for r in memory.counters(Tables(spark, SF).usage()).withColumn("roi", x.roi(F.col("wins"), F.col("uses"))).collect()}
    assert got == want


def test_sessions_run(spark, tmp_path):
    got = _all(spark, usage.sessions(_stream(spark, tmp_path)), "append", "sessions")
    assert set(got.columns) == {"start", "end", "artifact", "uses"}
