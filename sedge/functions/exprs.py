"""Scalar rules as Column expressions: everything here stays inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import log_patterns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A side of a join is only broadcast if an argument bounds it to so many rows.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows at most, to be broadcast if these are few; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fold(c: Column) -> Column:
    """Lower-cases A to Z only, as the NOCASE collation compares."""
    return F.translate(c, UPPER, LOWER)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1, and 0 for an empty or null text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("long")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of(*[c.contains(w) for w in words])


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


# Folders and endings of test files.
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs"]
TEST_SUFFIXES = r"([_-]test\.py|\.(test|spec)\.(ts|js|tsx|jsx)|_test\.go|(test|tests|testcase)\.java)$"


def is_test_file(path: Column) -> Column:
    """A folder of the path is a test folder, or the file's name is that of a test."""
    p = F.lower(slashes(path))
    folders = F.split(p, "/")
    folders = F.slice(folders, F.lit(1), F.size(folders) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | file_name(p).rlike(r"^test[_-]") | file_name(p).rlike(TEST_SUFFIXES)


def is_test_frame(path: Column) -> Column:
    """The looser rule for frames of a stack trace."""
    p = F.lower(slashes(path))
    return p.contains("tests/") | p.contains("test/") | file_name(p).rlike(r"^test_|_test\.py$|\.test\.(ts|js)$|_test\.go$")


# What marks a frame as one of a runtime, library or test runner.
FOREIGN_PARTS = [
    "site-packages/", "dist-packages/", "lib/python", "unittest/case.py", "/unittest/", "_pytest/", "/pytest/", "pluggy/", "importlib/", "node_modules/",
    "internal/process", "internal/modules", "jest-runner", "jest-circus", "@jest/", "mocha/", "src/runtime/", "library/std/src/", "library/core/src/", "/rustc/",
]
FOREIGN_STARTS = ["<frozen ", "<string>", "unittest/", "pytest/", "node:", "runtime/"]
FOREIGN_ENDS = ["testing/testing.go"]
FOREIGN_PATTERN = r"/(?:python\d*|pypy\d*|anaconda\d*|miniconda\d*)/lib/"


def is_project_frame(path: Column) -> Column:
    p = F.lower(slashes(path))
    foreign = any_of(*[p.contains(x) for x in FOREIGN_PARTS], *[p.startswith(x) for x in FOREIGN_STARTS], *[p.endswith(x) for x in FOREIGN_ENDS], p.rlike(FOREIGN_PATTERN))
    return F.when(F.coalesce(F.length(path), F.lit(0)) == 0, False).otherwise(~foreign)


def impact_level(fan_out: Column, ratio: Column) -> Column:
    """LOW to CRITICAL from the number of affected files and their percentage of all files."""
    return (
        F.when(fan_out == 0, "LOW")
        .when((fan_out <= 2) & (ratio < 15), "LOW")
        .when((fan_out <= 5) & (ratio < 35), "MEDIUM")
        .when((fan_out <= 12) & (ratio < 60), "HIGH")
        .otherwise("CRITICAL")
    )


def effort(depth: Column) -> Column:
    return F.when(depth <= 1, "LOW").when(depth == 2, "MEDIUM").otherwise("HIGH")


def boost_depth(targets: Column, direct: Column, transitive: Column, impact: Column) -> Column:
    """How many hops of impact a task context should show."""
    return F.when((transitive > 0) | impact.isin("HIGH", "CRITICAL"), 3).when((direct > 0) | (impact == "MEDIUM"), 2).when(targets > 0, 1).otherwise(0)


# The language that each extension stands for when code is folded.
SUFFIX_LANGUAGE = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "hpp": "cpp",
}


def suffix(path: Column) -> Column:
    """Lower-cased extension of the file name without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([A-Za-z0-9_+-]+)$", 1))


# What in a text shows its language, in this order, where the suffix does not.
SNIFFED = [
    ("python", r"(?m)^\s*(?:def|class|import|from|async\s+def)\s+|def |class |import |elif "),
    ("go", r"(?m)^\s*(?:package|func)\s+"),
    ("rust", r"\b(?:fn|impl|pub\s+fn)\b"),
    ("typescript", r"export interface|export class|: string|: number|const |let "),
    ("java", r"public class|System\.out\."),
]


def language_of(path: Column, text: Column | None = None) -> Column:
    """By the suffix; where that is unknown by the text, if it is given, and else null."""
    ext = suffix(path)
    known = F.create_map(*[F.lit(v) for kv in SUFFIX_LANGUAGE.items() for v in kv])[ext]
    if text is None:
        return known
    shown = reduce(lambda out, s: F.when(text.rlike(s[1]), s[0]).otherwise(out), reversed(SNIFFED), F.lit(None).cast("string"))
    return F.coalesce(known, shown)


def normalized_path(path: Column, workspace: str = "") -> Column:
    """Quotes and blanks trimmed, forward slashes, relative to the workspace, no leading ./"""
    p = slashes(F.regexp_replace(path, "^[\\s\"']+|[\\s\"']+$", ""))
    root = workspace.replace("\\", "/").rstrip("/")
    if root:
        p = F.when(p.startswith(root + "/"), F.substring(p, len(root) + 2, 1 << 30)).otherwise(p)
    return F.regexp_replace(p, r"^\./", "")


def joined_path(path: Column) -> Column:
    """Dots and double dots of a relative path resolved, by a fold over its segments."""
    empty = F.array().cast("array<string>")
    step = lambda a, x: (
        F.when(x.isin("", "."), a)
        .when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1))
        .otherwise(F.concat(a, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


# Scopes and the words that stand for them anywhere in file, type, message and diff;
# the first hit wins.
SCOPES: list[tuple[str, list[str]]] = [
    ("git.blast", ["blast", "blast_radius", "ingress"]),
    ("storage.sqlite", ["sqlite", "wal", "b-tree", "btree", "database"]),
    ("core.cache", ["cache"]),
    ("engine.ast", ["ast_scanner", "skeleton", "skeletonizer", "visitor", "unparse", "indentation"]),
    ("memory.pruning", ["darwin", "memory", "decay", "prun", "half_life", "roi"]),
    ("mcp.tools", ["mcp", "mcp_server", "json-rpc", "rpc", "stdio"]),
    ("backend.auth", ["auth", "jwt", "token", "login", "permission", "session"]),
    ("backend.api", ["api", "http", "router", "route", "endpoint", "request"]),
    ("frontend.ui", ["ui", "dom", "component", "render", "css", "view", "react"]),
]


def domain_scope(file: Column, kind: Column, message: Column, diff: Column) -> Column:
    blank = F.lit("")
    target = F.lower(F.coalesce(file, blank))
    text = F.lower(F.concat_ws(" ", F.coalesce(file, blank), F.coalesce(kind, blank), F.coalesce(message, blank), F.coalesce(diff, blank)))
    out = F.when(contains_any(text, ["cache_db", "ast_cache"]) | target.contains("cache"), "core.cache")
    for scope, words in SCOPES:
        hit = contains_any(text, words)
        out = out.when(hit | text.rlike("(^|[^a-z0-9_])ast([^a-z0-9_]|$)") if scope == "engine.ast" else hit, scope)
    return out.when(target.contains("ast"), "engine.ast").otherwise("core")


def laplace(success: Column, total: Column) -> Column:
    return (success + 1) / (total + 2)


def roi(success: Column, total: Column) -> Column:
    """Success rate and use together; an artifact that was never used keeps its prior."""
    score = 0.7 * laplace(success, total) + 0.3 * F.least(total / 5, F.lit(1.0))
    return F.when(total == 0, F.lit(0.35)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def half_life(value: Column, age_seconds: Column, days: Column | float) -> Column:
    return value * F.pow(F.lit(2.0), -F.greatest(age_seconds, F.lit(0.0)) / (F.lit(days) * 86400.0))


# Fixed value: the terminal codes that are removed from logs.
TERMINAL_CODES = r"\x1b\[[0-9;?]*[a-zA-Z]|\x1b\].*?\x07|\x1b[()][AB012]"


def clean_log(text: Column, keep: int = 3000) -> Column:
    """Terminal codes removed, line ends unified, only the last lines kept."""
    bare = F.regexp_replace(text, TERMINAL_CODES, "")
    return log_tail(F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), keep)


def log_tail(text: Column, keep: int) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > keep, F.array_join(F.slice(lines, F.greatest(F.size(lines) - keep + 1, F.lit(1)), F.lit(keep)), "\n")).otherwise(text)


def diff_added(diff: Column) -> Column:
    """Stripped text of the added lines of a diff."""
    added = F.filter(F.split(diff, "\r\n|\n|\r"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.transform(added, lambda x: F.regexp_replace(F.substring(x, 2, 1 << 30), r"^\s+|\s+$", ""))


def rule_name(forbidden: Column) -> Column:
    """The first three words of more than two characters, joined and sanitised."""
    words = F.slice(F.filter(F.split(F.trim(forbidden), r"\s+"), lambda w: F.length(w) > 2), 1, 3)
    raw = F.when(F.size(words) == 0, "guard_rule").otherwise(F.array_join(words, "_"))
    clean = F.lower(F.regexp_replace(raw, "[^A-Za-z0-9_]", ""))
    return F.when(clean == "", "learned_guard").otherwise(clean)


def short_id(*parts: Column) -> Column:
    """Ten hexadecimal digits that follow from the parts alone."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 10)


def clean_summary(text: Column) -> Column:
    """Without comment tags, headings and blank lines."""
    lines = F.split(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    return F.array_join(kept, "\n")


def runner(log: Column) -> Column:
    """Which runner or runtime wrote a cleaned log: the first that is known by its patterns."""
    out = F.lit("generic")
    for name, patterns in reversed(log_patterns.KNOWN):
        known = reduce(Column.__or__, [log.rlike(log_patterns.java(p)) for p in patterns])
        known = known & log.rlike(log_patterns.java(log_patterns.ALSO[name])) if name in log_patterns.ALSO else known
        out = F.when(known, name).otherwise(out)
    return out
