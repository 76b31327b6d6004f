"""Queries over the import graph, packages and rendering budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import exprs as x
from sedge.operators import dispatch, genome, graph, memory, monorepo, render, search
from sedge.plans.registry import query, values_sql


_KNOWN = ["src/utils.ts", "src/Button/index.tsx", "src/components/Button.tsx", "src/App.tsx", "src/index.ts", "src/my_pkg/core.py", "src/my_pkg/api.py", "src/legacy_module.py", "entry.ts", "lib/shared/mod.rs"]
_IMPORTS = [("src/App.tsx", "./utils"), ("src/App.tsx", "./Button"), ("src/App.tsx", "@/components/Button"), ("src/App.tsx", "~/utils"), ("entry.ts", "./src"), ("src/main.py", "my_pkg.core"), ("src/my_pkg/api.py", ".core"), ("src/main.py", "src.legacy_module"), ("src/main.py", "my_pkg.core.Thing"), ("src/main.py", "unknown"), ("entry.ts", "lib/shared")]
_RESOLVED = ["src/utils.ts", "src/Button/index.tsx", "src/components/Button.tsx", "src/utils.ts", "src/index.ts", "src/my_pkg/core.py", "src/my_pkg/core.py", "src/legacy_module.py", "src/index.ts", "src/index.ts", "lib/shared/mod.rs"]


@query("SELECT * FROM " + values_sql([(*i, d) for i, d in zip(_IMPORTS, _RESOLVED)], "caller, imp, dep"))
def resolve_imports(t):
    return graph.resolve(t.values(_IMPORTS, "caller string, imp string"), t.values([(p,) for p in _KNOWN], "path string"))


@query("SELECT dep, consumer FROM v_edges")
def ingress_edges(t):
    return graph.ingress(t.resolved())


_DOMAIN = ["src/auth/login.py", "tests/test_login.py", "src/cart.ts", "web/cart.test.ts", "pkg/pay.go", "pkg/pay_test.go", "tests/test-cart.js", "tests/unrelated_test.py"]


@query("SELECT * FROM " + values_sql([("src/auth/login.py", "tests/test_login.py"), ("src/cart.ts", "web/cart.test.ts"), ("src/cart.ts", "tests/test-cart.js"), ("pkg/pay.go", "pkg/pay_test.go")], "path, test"))
def tests_for_files(t):
    files = t.values([(p,) for p in _DOMAIN], "path string")
    return graph.tests_for(files.filter("path in ('src/auth/login.py', 'src/cart.ts', 'pkg/pay.go')"), files)


@query("SELECT DISTINCT relative_path FROM v_symbols WHERE name = 'red_widget' OR name LIKE '%.red\\_widget' ESCAPE '\\'")
def symbol_targets(t):
    return search.holders(t.symbols(), "red_widget")


_WALK = """WITH RECURSIVE base AS (SELECT e.dep, e.consumer, coalesce(t.is_test, FALSE) AS is_test FROM v_edges e LEFT JOIN v_tests t ON t.v = e.consumer),
    l1 AS (SELECT consumer AS v, 1 AS level, bool_or(is_test) AS is_test FROM base WHERE dep IN (7, 11) AND consumer NOT IN (7, 11) GROUP BY consumer),
    l2 AS (SELECT consumer AS v, 2 AS level, bool_or(b.is_test) AS is_test FROM base b JOIN l1 ON b.dep = l1.v AND NOT l1.is_test WHERE consumer NOT IN (7, 11) AND consumer NOT IN (SELECT v FROM l1) GROUP BY consumer),
    l3 AS (SELECT consumer AS v, 3 AS level, bool_or(b.is_test) AS is_test FROM base b JOIN l2 ON b.dep = l2.v AND NOT l2.is_test WHERE consumer NOT IN (7, 11) AND consumer NOT IN (SELECT v FROM l1 UNION SELECT v FROM l2) GROUP BY consumer),
    lv AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) """


def _levels(t):
    targets = t.values([(7,), (11,)], "v long")
    return graph.walk(t.edges(), t.tests(), targets, 3)


@query(_WALK + "SELECT v FROM lv WHERE level = 1 AND NOT is_test")
def blast_direct(t):
    return _levels(t).filter("level = 1 and not is_test").select("v")


@query(_WALK + "SELECT v FROM lv WHERE level > 1 AND NOT is_test")
def blast_transitive(t):
    return _levels(t).filter("level > 1 and not is_test").select("v")


@query(_WALK + "SELECT v, level, CASE WHEN is_test THEN 1 ELSE 0 END AS is_test FROM lv")
def blast_levels(t):
    return _levels(t).select("v", "level", F.col("is_test").cast("int").alias("is_test"))


@query(
    _WALK
    + """SELECT n AS total_files, d AS direct_fan_out, a AS total_fan_out, round(1e2 * a / n, 2) AS fan_out_ratio, CASE WHEN a = 0 THEN 'LOW' WHEN a <= 2 AND round(1e2 * a / n, 2) < 15 THEN 'LOW' WHEN a <= 5 AND round(1e2 * a / n, 2) < 35 THEN 'MEDIUM' WHEN a <= 12 AND round(1e2 * a / n, 2) < 60 THEN 'HIGH' ELSE 'CRITICAL' END AS impact
    FROM (SELECT count(*) AS n FROM customer), (SELECT count(*) FILTER (level = 1) AS d, count(*) AS a FROM lv WHERE NOT is_test)"""
)
def blast_metrics(t):
    return graph.metrics(_levels(t), t.customer.agg(F.count("*").alias("n")))


@query(_WALK + "SELECT v AS test, CASE WHEN level = 1 THEN 1 ELSE 2 END AS tier FROM lv WHERE is_test")
def blast_tests(t):
    tiers = _levels(t).filter("is_test").select(F.col("v").alias("test"), F.when(F.col("level") == 1, 1).otherwise(2).alias("tier"))
    return graph.ordered_tests(tiers)


@query("SELECT a.n AS targets, b.n AS direct, c.n AS transitive, CASE WHEN c.n > 0 OR i.v IN ('HIGH', 'CRITICAL') THEN 3 WHEN b.n > 0 OR i.v = 'MEDIUM' THEN 2 WHEN a.n > 0 THEN 1 ELSE 0 END AS depth, i.v AS impact FROM range(0, 2) a(n), range(0, 2) b(n), range(0, 2) c(n), (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) i(v)")
def boost_depth(t):
    two = t.spark.range(2)
    grid = two.toDF("targets").crossJoin(two.toDF("direct")).crossJoin(two.toDF("transitive")).crossJoin(t.values([("LOW",), ("MEDIUM",), ("HIGH",), ("CRITICAL",)], "impact string"))
    return grid.select("targets", "direct", "transitive", x.boost_depth(F.col("targets"), F.col("direct"), F.col("transitive"), F.col("impact")).alias("depth"), "impact")


_COMMANDS = [([], "python", True, "python -m unittest discover -s tests"), (["tests/test_a.py"], "python", True, "pytest -v tests/test_a.py"), (["tests/test_a.py"], "python", False, "python -m unittest tests/test_a.py"), (["web/a.test.ts"], "typescript", True, "npm test -- web/a.test.ts"), (["pkg/a_test.go"], "go", True, "go test pkg/a_test.go")]


@query("SELECT CAST(n AS BIGINT) AS n, command FROM " + values_sql([(i, c[3]) for i, c in enumerate(_COMMANDS)], "n, command"))
def test_command(t):
    return t.values([(i, graph.command(*c[:3])) for i, c in enumerate(_COMMANDS)], "n long, command string")


@query("SELECT path, package FROM (SELECT f.path, p.package, row_number() OVER (PARTITION BY f.path ORDER BY length(p.package) DESC) AS n FROM v_package_files f JOIN (SELECT package FROM v_packages UNION ALL SELECT DISTINCT r_name FROM v_packages) p ON starts_with(f.path, p.package || '/')) WHERE n = 1")
def package_assignment(t):
    packages = t.packages()
    folders = packages.select("package").unionByName(packages.select(F.col("r_name").alias("package")).distinct())
    return monorepo.assign(t.package_files().select("path"), folders)


_PACKS = [("auth-service", "@app/auth_service"), ("web-dashboard", "@app/auth-service"), ("core", "auth-service/client"), ("tools", "requests"), ("cli", "core.models")]


@query("SELECT * FROM " + values_sql([("web-dashboard", "auth-service"), ("core", "auth-service"), ("cli", "core")], "package, depends_on"))
def package_deps(t):
    return monorepo.dependencies(t.values(_PACKS, "package string, imp string"))


@query(
    """WITH n AS (SELECT owner AS package, count(*) AS n FROM v_package_files GROUP BY owner),
    d AS (SELECT a.package, string_agg(b.package, ', ' ORDER BY b.package) AS needs FROM v_packages a JOIN v_packages b ON a.n_nationkey % 5 = b.n_nationkey % 5 AND a.n_nationkey > b.n_nationkey GROUP BY a.package)
    SELECT p.package, '• ' || p.package || ' [Generic, ' || coalesce(n.n, 0) || ' files, ' || p.package || ']' || CASE WHEN d.needs IS NULL THEN '' ELSE ' -> ' || d.needs END AS line FROM v_packages p LEFT JOIN n USING (package) LEFT JOIN d USING (package)"""
)
def package_topology(t):
    kinds = t.packages().select("package", F.lit("Generic").alias("kind"), F.col("package").alias("rel_path"))
    key = t.packages().select("package", F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5).alias("g"))
    needs = key.join(key.toDF("depends_on", "k2", "g"), "g").filter("k > k2").select("package", "depends_on")
    return monorepo.root_map(t.package_files().select(F.col("owner").alias("package")), kinds, needs)


@query("SELECT CASE WHEN n_name IS NULL AND r_name IS NULL THEN 'all' WHEN n_name IS NULL THEN r_name ELSE r_name || '/' || n_name END AS package, CAST(count(*) AS BIGINT) AS files FROM customer JOIN v_packages ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def package_rollup(t):
    joined = t.customer.join(F.broadcast(t.packages()), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("r_name").isNull(), "all").when(F.col("n_name").isNull(), F.col("r_name")).otherwise(F.concat_ws("/", "r_name", "n_name"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("files")).select(name.alias("package"), "files")


@query("SELECT package FROM v_packages ORDER BY CASE WHEN contains('why is asia/nation_2 slow', lower(package)) THEN 0 ELSE 1 END, package LIMIT 1")
def package_match(t):
    return monorepo.match(t.packages().select("package"), "why is asia/nation_2 slow")


_SIGNATURES = [*genome.FRAMEWORKS, ("the", "Theta"), ("and", "Andes"), ("of", "Offshore")]


@query(f"SELECT DISTINCT f.framework FROM v_imports i JOIN {values_sql(_SIGNATURES, 'signature, framework').replace(' v(', ' f(')} ON lower(split_part(ltrim(i.imp, '/'), '/', 1)) = f.signature")
def framework_detect(t):
    return genome.frameworks(t.module_imports(), _SIGNATURES)


@query("SELECT owner, path FROM (SELECT owner, path, sum(length(path) + 1) OVER (PARTITION BY owner ORDER BY path ROWS UNBOUNDED PRECEDING) - 1 AS size FROM v_package_files) WHERE size < 4 * 101")
def budget_prefix(t):
    return render.within_budget(t.package_files().select("owner", "path"), "path", 100, ["owner"], F.col("path")).select("owner", "path")


@query(
    """SELECT id, line FROM (SELECT id, line, sum(length(line) + 1) OVER (ORDER BY roi DESC, id ROWS UNBOUNDED PRECEDING) - 1 AS size FROM (
    SELECT id, roi, '- [' || upper(kind) || '] **lesson ' || CAST(id AS VARCHAR) || '**' || CASE WHEN scope = 'global' THEN '' ELSE ' `[' || scope || ']`' END || CASE WHEN uses > 3 THEN ' `[' || kind || ', often]`' ELSE '' END || ': used ' || CAST(uses AS VARCHAR) || ' times' AS line FROM v_artifacts)) WHERE size < 4 * 501"""
)
def memory_summary_budget(t):
    tags = F.when(F.col("uses") > 3, F.array("kind", F.lit("often"))).otherwise(F.array().cast("array<string>"))
    named = t.artifacts().withColumns({"name": F.concat(F.lit("lesson "), F.col("id").cast("string")), "tags": tags, "content": F.concat(F.lit("used "), F.col("uses").cast("string"), F.lit(" times"))})
    lines = named.select("id", "roi", memory.summary_line().alias("line"))
    best = lines.orderBy(F.desc("roi"), "id").limit(4 * 501)
    return render.within_budget(best, "line", 500, [], F.desc("roi"), F.col("id")).select("id", "line")


_BLOCKS = [("dna", 1, 80), ("deps", 2, 80), ("apis", 3, 120), ("patterns", 1, 60), ("evolution", 4, 60)]


@query("SELECT block, CAST(greatest(floor(1200 * weight / 11e0), least_size) AS BIGINT) AS budget FROM " + values_sql(_BLOCKS, "block, weight, least_size"))
def budget_weights(t):
    return render.shares(t.values(_BLOCKS, "block string, weight int, floor int"), 1200)


@query("SELECT c.conv_id, c.turn, CASE WHEN EXISTS (SELECT 1 FROM (VALUES ('the'), ('tion')) w(word) WHERE contains(lower(c.text), w.word)) THEN 1 ELSE 0 END AS hit FROM conversations c")
def task_entity_match(t):
    words = render.task_words("of the tion")
    return t.conversations.select("conv_id", "turn", x.contains_any(F.lower("text"), words).cast("int").alias("hit"))


@query("SELECT action, tool FROM " + values_sql([("blast", "blast_radius"), ("symbols", "find_symbols"), ("eval", "harness_eval")], "action, tool"))
def action_alias(t):
    asked = t.values([("blast",), ("symbols",), ("eval",), ("nothing",)], "action string")
    return dispatch.tools_of(asked).select("action", "tool")


_RPC = [(1, '{"jsonrpc":"2.0","id":1,"method":"ping"}', "ok", 0), (2, '{"jsonrpc":"2.0","id":2,"method":"nope"}', "error", -32601), (3, '{"jsonrpc":"2.0","method":"initialized"}', "silent", 0), (4, "{broken", "error", -32700), (5, '{"id":5}', "error", -32600), (6, '{"jsonrpc":"2.0","id":6,"method":"resources/read","params":null}', "error", -32602)]


@query("SELECT CAST(n AS BIGINT) AS n, outcome, CAST(code AS BIGINT) AS code FROM " + values_sql([(r[0], r[2], r[3]) for r in _RPC], "n, outcome, code"))
def rpc_classify(t):
    return dispatch.classify(t.values([r[:2] for r in _RPC], "n long, line string"))


@query("SELECT c_nationkey, CAST(c_custkey AS BIGINT) AS c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 5")
def top_per_group(t):
    return graph.first_by(t.customer, ["c_nationkey"], F.desc("c_acctbal"), "c_custkey", n=5).select("c_nationkey", "c_custkey")
