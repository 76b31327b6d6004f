"""Import resolution, the inverted import graph and bounded walks over it.

A walk is a loop of at most max_depth joins; each level is written to the shared folder, so that
plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import exprs as x

PROBES = ["", ".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", "/__init__.py", "/index.ts", "/index.js", "/index.tsx", "/index.jsx", "/mod.rs"]


def shared_dir(spark) -> str:
    """A folder of the application in spark.checkpoint.dir. Where that is unset, a temporary folder
    for a local master (one machine), and an error for any other."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"file://{os.path.join(tempfile.gettempdir(), 'sedge-shared')}"
    return f"{configured.rstrip('/')}/graph-{spark.sparkContext.applicationId}"


def clean(spark) -> None:
    """Deletes what walks wrote in this application; their results are of no use then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def candidates(imp: Column, caller: Column, roots: list[str]) -> Column:
    """Base paths that an import may mean, best first."""
    name = F.regexp_replace(imp, "^[\\s\"']+|[\\s\"']+$", "")
    folder = F.when(caller.contains("/"), F.regexp_replace(caller, "/[^/]*$", "")).otherwise("")
    under = lambda d, p: F.when(d == "", p).otherwise(F.concat(d, F.lit("/"), p))
    slashed = F.translate(name, ".", "/")
    tail = F.substring(name, 3, 1 << 30)
    alias = F.concat(F.array(tail), *[F.array(F.concat(F.lit(f"{r}/"), tail)) for r in roots])
    dots = F.length(F.regexp_extract(name, r"^(\.+)", 1))
    relative_js = x.joined_path(under(folder, F.regexp_replace(name, r"\\", "/")))
    rest = F.translate(F.regexp_replace(name, r"^\.+", ""), ".", "/")
    up = x.joined_path(under(folder, F.repeat(F.lit("../"), dots - 1)))
    relative_py = F.when(rest == "", up).otherwise(under(up, rest))
    plain = F.concat(F.array(name, slashed, under(folder, name), under(folder, slashed)), *[F.array(F.concat(F.lit(f"{r}/"), name), F.concat(F.lit(f"{r}/"), slashed)) for r in roots])
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.array().cast("array<string>"))
        .when(name.startswith("@/") | name.startswith("~/"), F.concat(alias, plain))
        .when(name.startswith("./") | name.startswith("../"), F.array(relative_js))
        .when(name.startswith("."), F.array(relative_py))
        .otherwise(plain)
    )


def resolve(imports: DataFrame, files: DataFrame, roots: list[str] = ["src", "lib", "app", "packages"]) -> DataFrame:  # noqa: B006
    """imports (caller, imp) with the known file (files.path) that each of them means.

    Candidates and endings are tried in order; if none is known, the last segment of each candidate
    is dropped and all are tried again. Only distinct (folder, import) pairs are resolved, so hot
    imports cost one resolution a folder.
    """
    pairs = imports.select("imp", F.when(F.col("caller").contains("/"), F.concat(F.regexp_replace("caller", "/[^/]*$", ""), F.lit("/_"))).otherwise("_").alias("at")).distinct()
    bases = pairs.select("imp", "at", F.posexplode(candidates(F.col("imp"), F.col("at"), roots)).alias("rank", "base"))
    strip = lambda c: F.trim(c, F.lit("/"))
    tries = bases.select("imp", "at", "rank", F.explode(F.array(F.struct(F.lit(0).alias("round"), strip(F.col("base")).alias("b")), F.struct(F.lit(1).alias("round"), F.when(F.col("base").contains("/"), strip(F.regexp_replace("base", "/[^/]*$", ""))).otherwise("").alias("b")))).alias("t")).filter("t.b <> ''")
    probes = tries.select("imp", "at", "rank", "t.round", "t.b", F.posexplode(F.array(*map(F.lit, PROBES))).alias("probe", "s")).select("imp", "at", F.struct("round", "rank", "probe").alias("order"), F.concat("b", "s").alias("path"))
    found = probes.join(files.select("path").distinct(), "path").groupBy("imp", "at").agg(F.min_by("path", "order").alias("dep"))
    keyed = imports.withColumn("at", F.when(F.col("caller").contains("/"), F.concat(F.regexp_replace("caller", "/[^/]*$", ""), F.lit("/_"))).otherwise("_"))
    return keyed.join(found, ["imp", "at"]).select("caller", "imp", "dep")


def ingress(resolved: DataFrame) -> DataFrame:
    """Distinct edges (dep, consumer) without self-edges."""
    return resolved.select("dep", F.col("caller").alias("consumer")).filter("dep <> consumer").distinct()


def walk(edges: DataFrame, tests: DataFrame, targets: DataFrame, max_depth: int = 3) -> DataFrame:
    """v, level, is_test of what the targets (v) reach against the edges (dep, consumer).

    Level 1 is found for any max_depth. Tests (v, is_test) are reported at their first level but
    never walked on from; every vertex is reported once.
    """
    seen = written(targets.select("v").distinct())
    frontier, out = seen, None
    for level in range(1, max(1, max_depth) + 1):
        reached = frontier.join(edges, F.col("v") == F.col("dep")).select(F.col("consumer").alias("v")).distinct().join(seen, "v", "left_anti")
        reached = written(reached.join(tests, "v", "left").select("v", F.lit(level).alias("level"), F.coalesce("is_test", F.lit(False)).alias("is_test")))
        out = reached if out is None else out.unionByName(reached)
        frontier = reached.filter(~F.col("is_test")).select("v")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(reached.select("v"))
    return out


def metrics(levels: DataFrame, total_files: DataFrame) -> DataFrame:
    """One row: total_files (n), fan-outs of files that are no tests, their percentage, impact."""
    n = levels.filter(~F.col("is_test")).agg(F.count(F.when(F.col("level") == 1, 1)).alias("direct_fan_out"), F.count("*").alias("total_fan_out"))
    both = total_files.select(F.col("n").alias("total_files")).crossJoin(n)
    ratio = F.when(F.col("total_files") > 0, F.round(100.0 * F.col("total_fan_out") / F.col("total_files"), 2)).otherwise(0.0)
    return both.withColumn("fan_out_ratio", ratio).withColumn("impact", x.impact_level(F.col("total_fan_out"), F.col("fan_out_ratio")))


TEST_NAMES = ["test_{}", "{}_test", "test-{}", "{}-test", "{}"]


def stem(path: Column) -> Column:
    return F.regexp_replace(x.file_name(path), r"(.)\.[^.]*$", "$1")


def tests_for(affected: DataFrame, files: DataFrame) -> DataFrame:
    """path, test: test files (of files.path) whose stem is that of an affected file (path) or a
    test's name made from it. An affected stem loses one test prefix or suffix first."""
    bare = F.regexp_replace(F.regexp_replace(stem(F.col("path")), r"\.(test|spec)$", ""), r"^test[_-]|[_-]test$", "")
    names = F.explode(F.array(*[F.format_string(n.replace("{}", "%s"), bare) for n in TEST_NAMES])).alias("name")
    tests = files.filter(x.is_test_file(F.col("path"))).select(F.col("path").alias("test"), F.regexp_replace(stem(F.col("path")), r"\.(test|spec)$", "").alias("name"))
    return affected.select("path", names).distinct().join(tests, "name").select("path", "test").distinct()


def command(tests: list[str], language: str = "python", pytest: bool = True) -> str:
    """The command that runs the tests (none: the project's whole suite)."""
    if not tests:
        return {"typescript": "npm test", "javascript": "npm test", "go": "go test ./...", "rust": "cargo test"}.get(language, "python -m unittest discover -s tests")
    if any(t.endswith((".ts", ".tsx", ".js", ".jsx")) for t in tests):
        return "npm test -- " + " ".join(tests)
    if any(t.endswith(".go") for t in tests):
        return "go test " + " ".join(tests)
    if any(t.endswith(".rs") for t in tests):
        return "cargo test"
    return ("pytest -v " if pytest else "python -m unittest ") + " ".join(tests)


def ordered_tests(tiers: DataFrame) -> DataFrame:
    """test, tier: each test once, by its smallest tier, then by path."""
    return tiers.groupBy("test").agg(F.min("tier").alias("tier")).orderBy("tier", "test")


def first_by(df: DataFrame, keys: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first n rows by order of each group of keys; each task passes on n rows of a group at most."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
