"""Queries over files and symbols: scan, cache, lookup, full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import exprs as x
from sedge.operators import genome, graph, parse, scan, search, skeleton
from sedge.plans.registry import query, values_sql

SYMBOL = ["id", "name", "entity_type", "relative_path", "line_number"]
_SYM = "id, name, entity_type, relative_path, line_number"


@query("SELECT path, language, size FROM v_files WHERE source <> 'src3' ORDER BY path LIMIT 500")
def scan_filter(t):
    return scan.select_files(t.files(), ignored={"src3"}, max_files=500).select("path", "language", "size")


@query("SELECT path, total_lines, CASE WHEN (total_lines <= 1 AND size > 300) OR (total_lines > 1 AND size / CAST(total_lines AS DOUBLE) > 250) THEN 1 ELSE 0 END AS minified FROM v_files")
def minified_guard(t):
    return t.files().select("path", "total_lines", scan.is_minified(F.col("text"), F.col("total_lines")).cast("int").alias("minified"))


_PATHS = ["src/main.py", "domain.py", "lib/App.tsx", "server/index.js", "cmd/run.go", "util/helpers.py", "a/b/wsgi.py", "x/cli.rs", "pkg/mainframe.py", "app", "api/startup.js", "web/start.js"]


@query("SELECT path, CASE WHEN regexp_matches(lower(path), '(main|app|index|server|run|start|__main__|cli|wsgi|asgi)[.]') OR regexp_matches(lower(path), '(^|/)(main|app|index|server|run|start|__main__|cli|wsgi|asgi)([.][^.]*)?$') THEN 1 ELSE 0 END AS entry FROM (VALUES " + ", ".join(f"('{p}')" for p in _PATHS) + ") v(path)")
def entry_points(t):
    return t.values([(p,) for p in _PATHS], "path string").select("path", scan.is_entry(F.col("path")).cast("int").alias("entry"))


_STATUS = ["M  a.py", " M b.py", "MM c/d.py", "?? new.txt", "D  gone.py", " D gone2.py", "R  old.py -> fresh.py", "!! skipped.log", "x", ""]


@query("SELECT DISTINCT path FROM (SELECT trim(unnest(string_split(substr(line, 4), ' -> '))) AS path FROM (VALUES " + ", ".join(f"('{s}')" for s in _STATUS) + ") v(line) WHERE length(line) >= 3 AND trim(line) <> '' AND line NOT LIKE '!!%') WHERE path <> ''")
def git_porcelain(t):
    return scan.porcelain(t.values([(s,) for s in _STATUS], "line string"))


@query(
    """SELECT coalesce(c.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN c.path IS NULL THEN 'added' ELSE 'touched' END AS status
    FROM (SELECT path, CAST(doc_id AS DOUBLE) AS mtime FROM v_files WHERE doc_id % 13 <> 0) c FULL OUTER JOIN (SELECT path, CAST(doc_id AS DOUBLE) + CASE WHEN doc_id % 11 = 0 THEN 1e0 ELSE 0e0 END AS mtime FROM v_files WHERE doc_id % 7 <> 0) n ON c.path = n.path
    WHERE c.path IS NULL OR n.path IS NULL OR abs(c.mtime - n.mtime) > 1e-4"""
)
def change_detect(t):
    files = t.files().select("path", "doc_id")
    was = files.filter("doc_id % 13 <> 0").select("path", F.col("doc_id").cast("double").alias("mtime"))
    now = files.filter("doc_id % 7 <> 0").select("path", (F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("double").alias("mtime"))
    return scan.changes(was, now)


_TREE = ["services/auth/pyproject.toml", "services/auth/main.py", "web/package.json", "web/Cargo.toml", "go.mod", "legacy/auth/setup.py", "libs/core/CMakeLists.txt", "libs/core/requirements.txt"]


@query("SELECT * FROM (VALUES ('auth', 'legacy/auth', 'Python'), ('web', 'web', 'Node/JS/TS'), ('root', '', 'Go'), ('core', 'libs/core', 'Python')) v(name, rel_path, kind)")
def package_discovery(t):
    return scan.packages(t.values([(p,) for p in _TREE], "path string"))


_TODO = [("a.py", "x = 1\n# TODO: first thing\n#fixme: second \n// TODO: never"), ("b.md", "# NOTE: third\n# Heading\n# BUG: fourth"), ("c.py", "# todo: fifth\n# TODO: sixth")]


@query("SELECT path, CAST(line AS BIGINT) AS line, kind, note FROM (VALUES ('a.py', 2, 'TODO', 'first thing'), ('a.py', 3, 'FIXME', 'second'), ('b.md', 1, 'NOTE', 'third'), ('b.md', 3, 'BUG', 'fourth'), ('c.py', 1, 'TODO', 'fifth')) v(path, line, kind, note)")
def todo_markers(t):
    return scan.todo_markers(t.values(_TODO, "path string, text string"))


@query(
    """SELECT CAST(id AS VARCHAR) AS path, 0 AS position, container AS name, '' AS container, container AS simple_name, 'class' AS entity_type FROM v_symbols
    UNION ALL SELECT CAST(id AS VARCHAR), 1, name, container, simple_name, 'method' FROM v_symbols"""
)
def symbol_explode(t):
    entity = lambda kind, name: F.struct(F.lit(kind).alias("entity_type"), F.col(name).alias("name"), "signature", "docstring", "line_number")
    files = t.symbols().select(F.col("id").cast("string").alias("path"), F.array(entity("class", "container"), entity("method", "name")).alias("entities"))
    return parse.symbols(files).select("path", "position", "name", "container", "simple_name", "entity_type")


@query("SELECT path, size, 1 AS version FROM v_files WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 UNION ALL SELECT path, size, 2 FROM v_files WHERE doc_id % 4 = 0")
def upsert_replace(t):
    files = t.files().select("path", "size", "doc_id")
    old = files.filter("doc_id % 3 <> 0").select("path", "size", F.lit(1).alias("version"))
    return scan.upsert(old, files.filter("doc_id % 4 = 0").select("path", "size", F.lit(2).alias("version")))


@query("SELECT path, size FROM v_files WHERE doc_id % 4 <> 1")
def cache_lookup(t):
    files = t.files()
    cache = files.select("path", "size", F.col("doc_id").cast("double").alias("mtime"))
    wanted = files.select("path", (F.col("doc_id") + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).cast("double").alias("mtime"))
    return scan.lookup(cache, wanted).select("path", "size")


@query("SELECT CAST(count(*) FILTER (doc_id % 6 <> 0) AS BIGINT) AS kept, CAST(count(*) FILTER (doc_id % 6 = 0) AS BIGINT) AS gone FROM v_files")
def prune_missing(t):
    files = t.files().select("path", "doc_id")
    active = files.filter("doc_id % 6 <> 0").select("path")
    kept = scan.pruned(files, active).agg(F.count("*").alias("kept"))
    return kept.crossJoin(files.join(active, "path", "left_anti").agg(F.count("*").alias("gone")))


@query(
    """SELECT page_id, array_to_string(list_sort(list(imp))[1:15], ',') AS internal FROM v_imports WHERE imp LIKE '/%' OR imp LIKE '.%' OR imp LIKE '@/%' OR imp LIKE '~/%' GROUP BY page_id"""
)
def extract_imports(t):
    found = t.pages.select("page_id", parse.hrefs(F.col("html")).alias("imps"))
    inner = F.filter("imps", lambda i: i.startswith("/") | i.startswith(".") | i.startswith("@/") | i.startswith("~/"))
    return found.select("page_id", F.array_join(F.slice(F.array_sort(inner), 1, 15), ",").alias("internal")).filter("internal <> ''")


def _hits(where: str, order: str, limit: int = 50) -> str:
    return f"SELECT {_SYM} FROM v_symbols WHERE {where} ORDER BY {order} LIMIT {limit}"


_BEST = "CASE WHEN lower(simple_name) = '{0}' THEN 1 WHEN lower(name) = '{0}' THEN 2 ELSE 3 END, line_number, relative_path, id"


@query(_hits("lower(simple_name) = 'red_widget' OR lower(name) = 'red_widget'", _BEST.format("red_widget")))
def symbol_exact(t):
    return search.find(t.symbols(), "Red_Widget", exact=True).select(*SYMBOL)


@query(_hits("lower(simple_name) LIKE '%ring%' OR lower(name) LIKE '%ring%'", _BEST.format("ring")))
def symbol_substring(t):
    return search.find(t.symbols(), "RING").select(*SYMBOL)


@query(_hits("(lower(simple_name) LIKE '%bolt%' OR lower(name) LIKE '%bolt%') AND entity_type = 'economy' AND relative_path LIKE '%pkg\\_1%' ESCAPE '\\'", _BEST.format("bolt"), 20))
def symbol_filtered(t):
    return search.find(t.symbols(), "bolt", kind="economy", path="pkg_1", limit=20).select(*SYMBOL)


@query(
    """SELECT q, CAST(place AS INTEGER) AS place, id FROM (SELECT q.q, s.id, row_number() OVER (PARTITION BY q.q ORDER BY CASE WHEN lower(s.simple_name) = q.q THEN 1 ELSE 2 END, s.line_number, s.relative_path, s.id) AS place
    FROM (SELECT lower(simple_name) AS q FROM v_symbols UNION SELECT lower(name) FROM v_symbols) q JOIN v_symbols s ON lower(s.simple_name) = q.q OR lower(s.name) = q.q) WHERE place <= 50"""
)
def symbol_lookup_batch(t):
    """Every different name of the table looked up at once, as so many exact finds would."""
    names = t.symbols().select(F.explode(F.array(x.fold(F.col("simple_name")), x.fold(F.col("name")))).alias("q")).distinct()
    return search.lookup(t.symbols(), names).select("q", "place", "id")


@query(_hits("TRUE", "relative_path, line_number, id", 100))
def symbol_all_sorted(t):
    return search.find(t.symbols(), limit=100).select(*SYMBOL)


_WILD = [(1, "calc_100%_func", 5), (2, "calc_other_func", 9), (3, "calcX100Y", 2)]


@query("SELECT CAST(1 AS BIGINT) AS id, 'calc_100%_func' AS name")
def symbol_wildcard_escape(t):
    rows = t.values(_WILD, "id long, name string, line_number int").withColumns({"simple_name": F.col("name"), "entity_type": F.lit("function"), "relative_path": F.lit("m.py")})
    return search.find(rows, "100%").select("id", "name")


_BODY = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {w} AS weight, {c} AS body FROM v_symbols" for c, w in search.WEIGHTS.items())
_POST = f"post AS (SELECT id, col, weight, term FROM (SELECT id, col, weight, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS term FROM ({_BODY})) WHERE term <> '')"


def _bm25(prefixes: list[str], limit: int) -> str:
    q = ", ".join(f"({i}, '{p}')" for i, p in enumerate(prefixes))
    return f"""WITH {_POST}, lens AS (SELECT id, count(*) AS d FROM post GROUP BY id), tot AS (SELECT count(*) AS docs, avg(d) AS mean FROM lens),
    hits AS (SELECT id, p, CAST(sum(weight) AS DOUBLE) AS f FROM post JOIN (VALUES {q}) q(p, pre) ON starts_with(term, pre) GROUP BY id, p),
    ns AS (SELECT p, count(*) AS n FROM hits GROUP BY p)
    SELECT id, round(-sum(CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * d / mean))), 6) AS score
    FROM hits JOIN ns USING (p) JOIN lens USING (id), tot GROUP BY id ORDER BY score, id LIMIT {limit}"""


@query(_bm25(["red", "widget", "economy"], 20))
def bm25_search(t):
    symbols = t.symbols()
    return search.bm25(search.postings(symbols), search.lengths(symbols), "red widget economy")


@query(_bm25(["wid", "sm", "brand"], 50))
def bm25_prefix(t):
    symbols = t.symbols()
    return search.bm25(search.postings(symbols), search.lengths(symbols), "wid sm brand", 50)


@query(_hits("lower(simple_name) LIKE '%dge%' OR lower(name) LIKE '%dge%'", _BEST.format("dge"), 20))
def bm25_fallback(t):
    return search.search(t.symbols(), "dge").select(*SYMBOL)


@query(f"WITH {_POST} SELECT col, term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS docs FROM post GROUP BY col, term")
def tokenize_postings(t):
    return search.vocabulary(t.symbols())


_FILES = ["tests/helpers/data.py", "src/test_a.py", "src/a_test.py", "web/App.test.tsx", "web/app.spec.js", "pkg/x_test.go", "src/main/FooTest.java", "src/FooTestCase.java", "src/contest.py", "spec", "a/__tests__/b.ts", "lib/test-run.js", "src/latest.go", "x\\tests\\y.py"]


@query("SELECT path, CASE WHEN regexp_matches(lower(replace(path, chr(92), '/')), '(^|/)(test|tests|__tests__|spec|specs)/') OR regexp_matches(lower(replace(path, chr(92), '/')), '(^|/)test[_-][^/]*$') OR regexp_matches(lower(path), '([_-]test[.]py|[.](test|spec)[.](ts|js|tsx|jsx)|_test[.]go|(test|tests|testcase)[.]java)$') THEN 1 ELSE 0 END AS is_test FROM (VALUES " + ", ".join(f"('{p}')" for p in _FILES) + ") v(path)")
def is_test_file(t):
    return t.values([(p,) for p in _FILES], "path string").select("path", x.is_test_file(F.col("path")).cast("int").alias("is_test"))


_FRAMES = ["src/app/core.py", "/usr/lib/python3.11/json/decoder.py", "venv/Lib/site-packages/requests/api.py", "<frozen importlib._bootstrap>", "node_modules/jest/x.js", "cmd/server/main.go", "/rustc/abc/library/std/src/panicking.rs", "lib/util.rs", "node:internal/process/task"]


@query("SELECT path, project FROM (VALUES " + ", ".join(f"('{p}', {int(p in ('src/app/core.py', 'cmd/server/main.go', 'lib/util.rs'))})" for p in _FRAMES) + ") v(path, project)")
def classify_frame(t):
    return t.values([(p,) for p in _FRAMES], "path string").select("path", x.is_project_frame(F.col("path")).cast("int").alias("project"))


_SNIFF = [("a", "def f(): pass", "python"), ("b", "package main", "go"), ("c", "pub fn x() {}", "rust"), ("d", "let a = 1", "typescript"), ("e", "System.out.print(1)", "java"), ("f.rs", "def f", "rust"), ("g.txt", "plain", "")]


@query("SELECT path, language FROM " + values_sql([(s[0], s[2]) for s in _SNIFF], "path, language"))
def sniff_language(t):
    return t.values([s[:2] for s in _SNIFF], "path string, text string").select("path", F.coalesce(x.language_of(F.col("path"), F.col("text")), F.lit("")).alias("language"))


_LANGS = {"a/b.py": "python", "c.TSX": "typescript", "d.jsx": "javascript", "e.rs": "rust", "f.hpp": "cpp", "g.h": "c", "i.java": "java", "j.cs": "csharp", "k.go": "go", "l.cc": "cpp"}


@query("SELECT path, language FROM (VALUES " + ", ".join(f"('{p}', '{v}')" for p, v in _LANGS.items()) + ") v(path, language)")
def infer_language(t):
    return t.values([(p,) for p in _LANGS], "path string").select("path", x.language_of(F.col("path")).alias("language"))


@query(
    """SELECT f.n AS fan_out, r.n * 5 AS ratio, CASE WHEN f.n = 0 THEN 'LOW' WHEN f.n <= 2 AND r.n * 5 < 15 THEN 'LOW' WHEN f.n <= 5 AND r.n * 5 < 35 THEN 'MEDIUM' WHEN f.n <= 12 AND r.n * 5 < 60 THEN 'HIGH' ELSE 'CRITICAL' END AS impact
    FROM range(0, 20) f(n), range(0, 20) r(n)"""
)
def impact_level(t):
    grid = t.spark.range(20).select(F.col("id").alias("fan_out")).crossJoin(t.spark.range(20).select((F.col("id") * 5).alias("ratio")))
    return grid.select("fan_out", "ratio", x.impact_level(F.col("fan_out"), F.col("ratio")).alias("impact"))


@query("SELECT n AS depth, CASE WHEN n <= 1 THEN 'LOW' WHEN n = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS effort FROM range(0, 6) r(n)")
def effort_calibration(t):
    return t.spark.range(6).select(F.col("id").alias("depth"), x.effort(F.col("id")).alias("effort"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT language, CAST(count(*) AS BIGINT) AS files FROM v_files GROUP BY language ORDER BY files DESC, language LIMIT 5")
def language_counts(t):
    return genome.languages(t.files()).withColumnRenamed("n", "files")


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(total_lines) AS BIGINT) AS lines, max(CASE WHEN regexp_matches(lower(path), 'unittest|test_') THEN 1 ELSE 0 END) AS tested FROM v_files")
def corpus_totals(t):
    return genome.totals(t.files()).withColumnRenamed("n", "files")


@query("SELECT DISTINCT split_part(path, '/', 1) AS module FROM v_files ORDER BY module LIMIT 10")
def modules(t):
    return genome.modules(t.files()).withColumnRenamed("m", "module")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, 'src/' || source || CASE WHEN doc_id % 9 = 0 THEN '/main.py' ELSE '/doc_' || doc_id || '.py' END AS path FROM documents WHERE doc_id % 9 = 0 ORDER BY path, doc_id LIMIT 5")
def entry_point_top(t):
    named = t.documents.select("doc_id", F.concat(F.lit("src/"), "source", F.when(F.col("doc_id") % 9 == 0, "/main.py").otherwise(F.concat(F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")))).alias("path"))
    first = genome.entry_points(named.withColumn("entry", scan.is_entry(F.col("path"))).withColumn("path", F.format_string("%s %09d", "path", "doc_id")))
    return first.select(F.substring_index("path", " ", -1).cast("long").alias("doc_id"), F.substring_index("path", " ", 1).alias("path"))


@query("SELECT 'page_' || CAST(page_id AS VARCHAR) AS path, array_to_string(list_sort(list(imp))[1:5], ',') AS needs FROM v_imports GROUP BY page_id")
def internal_graph(t):
    return genome.internal_graph(t.module_imports()).withColumn("needs", F.array_join("needs", ","))


_BUILDS = [("a", ["setup.py", "package.json"], "python-pip/setuptools"), ("b", ["package.json", "Cargo.toml"], "npm/yarn"), ("c", ["Cargo.toml", "go.mod"], "cargo"), ("d", ["go.mod"], "go-modules"), ("e", ["README"], "custom")]


@query("SELECT * FROM " + values_sql([(b[0], b[2]) for b in _BUILDS], "name, build"))
def build_systems(t):
    return t.values([(b[0], genome.build_system(b[1])) for b in _BUILDS], "name string, build string")


@query("SELECT DISTINCT split_part(ltrim(imp, '/'), '/', 1) AS package FROM v_imports ORDER BY package LIMIT 20")
def external_packages(t):
    return genome.packages(t.module_imports())


@query("SELECT imp, CAST(count(*) AS BIGINT) AS fan_in FROM v_imports GROUP BY imp ORDER BY fan_in DESC, imp LIMIT 5")
def hotspots(t):
    return genome.hotspots(t.module_imports())


def _kinds(t):
    """Symbols as classes, functions and methods, by their numbers."""
    kind = F.when(F.col("id") % 3 == 0, "class").when(F.col("id") % 3 == 1, "function").otherwise("method")
    text = F.when(F.col("id") % 12 == 1, F.concat(F.lit("async "), "signature")).when(F.col("id") % 30 == 0, F.concat(F.lit("@dataclass "), "signature")).otherwise(F.col("signature"))
    return t.symbols().withColumns({"entity_type": kind, "signature": text, "path": F.col("relative_path"), "position": F.col("id")})


@query(
    """SELECT id AS position, CASE id % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN id % 12 = 1 THEN 'async ' WHEN id % 30 = 0 THEN '@dataclass ' ELSE '' END || signature || ' [' || relative_path || ':' || CAST(line_number AS VARCHAR) || '] - ' || substr(docstring, 1, 40) AS line
    FROM v_symbols WHERE id % 3 <> 2"""
)
def api_registry(t):
    return genome.registry(_kinds(t)).select("position", "kind", "line")


@query("SELECT max(CASE WHEN id % 12 = 1 THEN 1 ELSE 0 END) AS any_async, max(CASE WHEN id % 30 = 0 THEN 1 ELSE 0 END) AS any_dataclass FROM v_symbols")
def paradigms(t):
    return genome.paradigms(_kinds(t)).withColumnsRenamed({"a": "any_async", "d": "any_dataclass"})


@query("SELECT doc_id, left(sha256(text), 10) AS hash FROM v_files")
def content_hash(t):
    return t.files().select("doc_id", x.short_id(F.col("text")).alias("hash"))


@query("SELECT doc_id, CAST(CASE WHEN size = 0 THEN 0 ELSE greatest(1, size // 4) END AS BIGINT) AS tokens FROM v_files")
def token_estimate(t):
    return t.files().select("doc_id", x.token_estimate(F.col("text")).alias("tokens"))


@query()  # no SQL folds code; tests/test_whole.py has it against skeletons written by hand
def compression_ratio(t):
    folded = skeleton.skeletons(t.files().select("language", "text"))
    return folded.groupBy("language").agg(F.round(1 - F.sum("tokens") / F.sum(x.token_estimate(F.col("text"))), 6).alias("ratio"))


@query("SELECT DISTINCT path FROM v_files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def set_union_files(t):
    f = t.files()
    return f.filter("doc_id % 2 = 0").select("path").unionByName(f.filter("doc_id % 3 = 0").select("path")).distinct()


@query("SELECT DISTINCT path FROM v_files WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def set_except_prune(t):
    f = t.files()
    return f.filter("doc_id % 2 = 0").select("path").subtract(f.filter("doc_id % 3 = 0").select("path"))


@query("SELECT simple_name FROM v_symbols WHERE id % 2 = 0 INTERSECT SELECT simple_name FROM v_symbols WHERE id % 5 = 0")
def set_intersect_terms(t):
    s = t.symbols()
    return s.filter("id % 2 = 0").select("simple_name").intersect(s.filter("id % 5 = 0").select("simple_name"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: TRUE)[-3:], chr(10)) AS tail FROM v_files")
def log_tail(t):
    return t.files().select("doc_id", x.log_tail(F.col("text"), 3).alias("tail"))


@query("SELECT artifact, event_id AS first_event FROM (SELECT artifact, event_id, row_number() OVER (PARTITION BY artifact ORDER BY us, event_id) AS n FROM v_usage) WHERE n = 1")
def first_seen_dedup(t):
    return graph.first_by(t.usage(), ["artifact"], "us", "event_id").select("artifact", F.col("event_id").alias("first_event"))
