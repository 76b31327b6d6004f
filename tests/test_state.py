"""What a project keeps between runs: scans, lessons that come back, generations, rules."""

import os
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from sedge.engine import Project, state_folder
from sedge.functions import exprs as x
from sedge.operators import graph, harness, monorepo, search
from sedge.sources import files as sources
from sedge.streaming import usage


@pytest.fixture()
def tree(tmp_path):
    for path, text in {"src/a.py": "def a():\n    return 1\n", "src/b.py": "from src.a import a\n", "src/c.py": "import b\n", "web/[id].ts": "export const x = 1\n", "packages/kit/src/tool.py": "def tool(): pass\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def project(spark, tree, state):
    return Project(spark, str(tree), f"file://{state}")


def test_a_second_scan_reads_what_changed(spark, tree, tmp_path_factory, monkeypatch):
    state = tmp_path_factory.mktemp("state")
    first = project(spark, tree, state)
    assert first.changed() == ([], "empty_cache")
    assert first.files.count() == 5 and first.changed() == ([], "mtime_cache")
    (tree / "src/a.py").write_text("def a():\n    return 2\n\ndef new(): pass\n")
    os.utime(tree / "src/a.py", (1_700_000_000, 1_700_000_000))
    (tree / "src/d.py").write_text("x = 1\n")
    (tree / "src/c.py").unlink()
    second = project(spark, tree, state)
    assert second.changed() == (["src/a.py", "src/c.py", "src/d.py"], "mtime_cache")
    read, source_files = [], sources.source_files
    monkeypatch.setattr(sources, "source_files", lambda *a, **k: (read.append(source_files(*a, **k)), read[-1])[1])
    assert {r["name"] for r in second.symbols.collect()} >= {"a", "new", "tool"}
    assert sorted(r.path for r in read[0].select("path").collect()) == ["src/a.py", "src/d.py"]
    assert sorted(r.path for r in second.files.select("path").collect()) == ["packages/kit/src/tool.py", "src/a.py", "src/b.py", "src/d.py", "web/[id].ts"]
    assert project(spark, tree, state).files.count() == 5 and len(read) == 1


def test_a_deleted_target_still_has_its_consumers(spark, tree, tmp_path_factory):
    (tree / "src/a.py").unlink()
    one = project(spark, tree, tmp_path_factory.mktemp("state"))
    assert one.impact(["src/a.py"])["direct"] == ["src/b.py"] and one.impact(["src/nothing.py"])["direct"] == []


def test_source_roots_and_state_folder(spark, tree, tmp_path_factory):
    one = project(spark, tree, tmp_path_factory.mktemp("state"))
    assert one.source_roots == ["src", "packages", "packages/kit", "packages/kit/src"]
    assert state_folder(str(tree)) == f"{tree}/.sedge" and state_folder(str(tree), "s3://x/y") == "s3://x/y"
    (tree / ".agents/.sedge").mkdir(parents=True)
    assert state_folder(str(tree)) == f"{tree}/.agents/.sedge"


def test_a_pruned_lesson_comes_back(spark, tree, tmp_path_factory):
    one = project(spark, tree, tmp_path_factory.mktemp("state"))
    key = one.learn("Cache Key Validation", "Always validate the format", "core.cache", ["cache", "keys"])
    again = one.learn(" cache key validation", "Always validate format and length", "core.cache.v2", ["validation", "keys"])
    row = one.artifacts().filter(F.col("id") == key).first()
    assert again == key and (row.scope, row.content, row.tags, row.uses, row.wins) == ("core.cache.v2", "Always validate format and length", ["cache", "keys", "validation"], 2, 2)
    assert one.evolve(threshold=2.0)["pruned_count"] == 1
    assert one.artifacts().count() == 0 and one.artifacts(pruned=True).count() == 1
    assert one.use(key, True) is None and one.use("unknown", True) is None
    assert one.learn("Other name", "always validate format AND length ", "core.cache.v2", []) == key
    row = one.artifacts().filter(F.col("id") == key).first()
    assert (row["name"], row.uses, row.tags) == ("Cache Key Validation", 3, ["cache", "keys", "validation"])
    assert one.use(key, False) == key


def test_generations_are_kept(spark, tree, tmp_path_factory):
    one = project(spark, tree, tmp_path_factory.mktemp("state"))
    key = one.remember("a", "b")
    roi = lambda: one.artifacts().filter(F.col("id") == key).first().roi
    whole = roi()
    done = one.evolve(threshold=0.0)
    assert done["generation"] == 1 and roi() == pytest.approx(whole * 0.95) and done["top_artifacts"][0]["id"] == key
    one.evolve(threshold=0.0)
    assert roi() == pytest.approx(whole * 0.95**2)
    one.use(key, True)
    assert roi() > whole


def test_preferences_text_keeps_its_budget(spark, tree, tmp_path_factory):
    one = project(spark, tree, tmp_path_factory.mktemp("state"))
    one.feedback("correction", "Do not use eval, instead use literal_eval.")
    text = one.preferences_text()
    assert text.startswith("### 🧬 Developer Preferences & Invariant Guards\n- **Project Trajectory**: Phase") and "- [PREF:STYLE] **prefer_eval**: Prefer literal_eval over eval (conf: 90%)" in text
    assert len(one.preferences_text(60)) // 4 <= 60


def test_language_by_content(spark):
    rows = [("a", "def f(): pass", "python"), ("b", "package main\n", "go"), ("c", "pub fn x() {}", "rust"), ("d", "const a = 1", "typescript"), ("e", "System.out.print(1)", "java"), ("f.rs", "def f", "rust"), ("g.txt", "plain", None), ("h", None, None)]
    got = spark.createDataFrame(rows, "path string, text string, want string").select("want", x.language_of(F.col("path"), F.col("text")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_folding_equals_the_tokenizer_of_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c)) in ("Ll", "Lu") and chr(c) != "İ"] + ["é", "đừng", "không", "Việt"]
    for i, c in enumerate(letters):
        con.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, f"a{c}b"))
    want = {doc: term for term, doc in con.execute("SELECT term, doc FROM v")}
    got = spark.createDataFrame(list(enumerate(f"a{c}b" for c in letters)), "i long, t string").select("i", search.terms(F.col("t")).alias("t")).collect()
    wrong = [(letters[r.i], r.t, want[r.i]) for r in got if r.t != [want[r.i]]]
    assert [w for w in wrong if len(w[2]) == 3 and w[2][1] in "abcdefghijklmnopqrstuvwxyz"] == [] and "ǡ" not in search.ACCENTS
    assert all(want[r.i] == r.t[0] for r in got if letters[r.i] in ("đừng", "không", "Việt", "é"))


def test_feedback_is_counted_in_spans(spark, monkeypatch):
    monkeypatch.setattr(harness, "SPAN", 4)
    events = [("a" if n % 3 else "b", n) for n in range(40)]
    asked = [(i, "ab"[i % 2], 3 * i - 2) for i in range(14)]
    got = {r.id: r.times for r in harness.later(spark.createDataFrame(events, "scope string, n long"), spark.createDataFrame(asked, "id long, scope string, n long")).collect()}
    assert got == {i: sum(s == scope and m > n for s, m in events) for i, scope, n in asked}


def test_the_newest_row_is_kept(spark):
    rows = [(1, 2, "old"), (1, 5, "new"), (1, 3, "late"), (2, 1, "x")]
    got = usage.newest(spark.createDataFrame(rows, "artifact long, uses long, what string")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, "new"), (2, 1, "x")]


def test_long_imports_are_matched_by_parts(spark):
    long = "x" * 3000 + "auth_service" + "y" * 3000
    rows = [("core", long), ("auth-service", "none"), ("web", "core")]
    got = {tuple(r) for r in monorepo.dependencies(spark.createDataFrame(rows, "package string, imp string")).collect()}
    assert got == {("core", "auth-service"), ("web", "core")}


def test_walks_can_be_cleaned(spark):
    graph.written(spark.range(3))
    graph.clean(spark)
    assert graph.written(spark.range(3)).count() == 3


def test_large_sides_are_not_broadcast(spark):
    df = spark.range(3)
    hinted = lambda rows: "broadcast" in x.bounded(df, rows)._jdf.queryExecution().logical().toString().lower()
    assert hinted(10) and not hinted(x.BROADCAST_ROWS + 1)

