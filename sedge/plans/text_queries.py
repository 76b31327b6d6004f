"""Queries over logs, source code and texts that are folded, rendered or replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import exprs as x
from sedge.operators import errors, genome, parse, render, sinks, skeleton
from sedge.plans.registry import query, values_sql

_LOGS = [
    ("pytest", "===== FAILURES =====\n____ test_total ____\nsrc/cart.py:31: in total\nE   TypeError: unsupported operand\nFAILED tests/test_cart.py::test_total - TypeError: unsupported operand", "TypeError", "unsupported operand", "src/cart.py", 31),
    ("unittest", 'FAIL: test_sum (tests.test_math.Sums)\nTraceback (most recent call last):\n  File "tests/test_math.py", line 8, in test_sum\n    self.assertEqual(add(1, 1), 3)\n  File "src/math.py", line 4, in add\n    raise ValueError("no")\nValueError: no\n\nRan 1 test', "ValueError", "no", "src/math.py", 4),
    ("jest", "FAIL web/cart.test.ts\n  ● cart › adds\n    expect(received).toBe(expected)\n    Expected: 3\n    Received: 2\n      at Object.<anonymous> (web/cart.test.ts:7:15)\n      at add (web/cart.ts:3:9)", "AssertionError", "Expected: 3, Received: 2", "web/cart.ts", 3),
    ("go_test", "--- FAIL: TestPay (0.00s)\n    pkg/pay_test.go:17: got 1 want 2\nFAIL", "TestFailure", "got 1 want 2", "pkg/pay_test.go", 17),
    ("go", "panic: runtime error: index out of range [3] with length 3\n\ngoroutine 1 [running]:\nmain.pick(...)\n\tcmd/pick.go:12 +0x1d\nmain.main()\n\tcmd/main.go:5 +0x2f", "IndexOutOfRange", "index out of range [3] with length 3", "cmd/main.go", 5),
    ("rust", "thread 'main' panicked at 'called `Option::unwrap()` on a `None` value', src/main.rs:9:14", "UnwrapNone", "called `Option::unwrap()` on a `None` value", "src/main.rs", 9),
    ("python", 'Traceback (most recent call last):\n  File "app/run.py", line 3, in <module>\n    main()\n  File "/usr/lib/python3.11/json/decoder.py", line 355, in raw_decode\n    raise JSONDecodeError\nKeyError: \'user\'', "KeyError", "'user'", "app/run.py", 3),
    ("python", 'Traceback (most recent call last):\n  File "a.py", line 1, in f\nOSError: gone\n\nDuring handling of the above exception, another exception occurred:\n\nTraceback (most recent call last):\n  File "b.py", line 2, in g\nRuntimeError: worse', "RuntimeError", "worse", "b.py", 2),
    ("node", "RangeError: too deep\n    at walk (src/tree.js:8:3)\n    at node:internal/main:10:1", "RangeError", "too deep", "src/tree.js", 8),
    ("generic", "starting\nFATAL: disk is full at store/disk.c:88\nbye", "RuntimeError", "disk is full at store/disk.c:88", "store/disk.c", 88),
]


def _logs(t):
    return t.values([(i, e[1].replace("\n", "\r\n") if i % 2 else "\x1b[31m" + e[1] + "\x1b[0m") for i, e in enumerate(_LOGS)], "n long, log string")


@query("SELECT CAST(n AS BIGINT) AS n, runner, error_type, error_message, file, CAST(line AS BIGINT) AS line, CAST(chained AS BIGINT) AS chained FROM " + values_sql([(i, e[0], *e[2:], int(i == 7)) for i, e in enumerate(_LOGS)], "n, runner, error_type, error_message, file, line, chained"))
def error_extract(t):
    got = errors.extracted(_logs(t))
    root = errors.root_cause(F.col("frames"))
    return got.select("n", "runner", "error_type", "error_message", root["file"].alias("file"), root["line"].cast("long").alias("line"), F.col("chained").cast("long").alias("chained"))


@query("SELECT CAST(n AS BIGINT) AS n, runner FROM " + values_sql([(i, e[0]) for i, e in enumerate(_LOGS)], "n, runner"))
def runner_detect(t):
    return _logs(t).select("n", x.runner(x.clean_log(F.col("log"))).alias("runner"))


@query("SELECT CAST(n AS BIGINT) AS n, text FROM " + values_sql([(i, e[1]) for i, e in enumerate(_LOGS)], "n, text"))
def clean_log(t):
    return _logs(t).select("n", x.clean_log(F.col("log")).alias("text"))


_STACKS = [(1, ["src/a.py", "tests/test_a.py", "/usr/lib/python3.11/abc.py"], "src/a.py"), (2, ["tests/test_a.py", "site-packages/x.py"], "tests/test_a.py"), (3, ["site-packages/x.py", "node_modules/y.js"], "node_modules/y.js"), (4, [], None), (5, ["src/a.py", "src/b.py"], "src/b.py")]


@query("SELECT CAST(n AS BIGINT) AS n, file FROM " + values_sql([(r[0], r[2] or "") for r in _STACKS], "n, file"))
def root_cause_frame(t):
    rows = t.values([(r[0], [(f, 1, "", "") for f in r[1]]) for r in _STACKS], f"n long, frames {errors.FRAMES}")
    return rows.select("n", F.coalesce(errors.root_cause(F.col("frames"))["file"], F.lit("")).alias("file"))


_PATHS = [(" 'C:\\ws\\src\\a.py' ", "src/a.py"), ("./lib/b.ts", "lib/b.ts"), ('"pkg/c.go"', "pkg/c.go"), ("C:/ws/d.rs", "d.rs"), ("/other/e.c", "/other/e.c")]


@query("SELECT raw, path FROM " + values_sql(_PATHS, "raw, path"))
def normalize_path(t):
    return t.values([(p[0],) for p in _PATHS], "raw string").select("raw", x.normalized_path(F.col("raw"), "C:/ws").alias("path"))


_DOMAINS = [("core/ast_cache.py", "OSError", "x", "", "core.cache"), ("a/wal.py", "OSError", "x", "", "storage.sqlite"), ("a/b.py", "SyntaxError", "bad visitor", "", "engine.ast"), ("git/impact.py", "E", "ingress", "", "git.blast"), ("svc/x.py", "E", "jwt expired", "", "backend.auth"), ("svc/x.py", "E", "no such route", "", "backend.api"), ("web/x.ts", "E", "no dom", "", "frontend.ui"), ("a/b.py", "E", "odd", "+ memory = 1", "memory.pruning"), ("a/b.py", "E", "odd", "", "core"), ("a/b.py", "E", "stdio closed", "", "mcp.tools")]


@query("SELECT file, kind, message, scope FROM " + values_sql([(d[0], d[1], d[2], d[4]) for d in _DOMAINS], "file, kind, message, scope"))
def domain_scope(t):
    rows = t.values([d[:4] for d in _DOMAINS], "file string, kind string, message string, diff string")
    return rows.select("file", "kind", "message", x.domain_scope(F.col("file"), F.col("kind"), F.col("message"), F.col("diff")).alias("scope"))


_DIFF = "--- a/x.py\n+++ b/x.py\n-old\n+  new line  \n context\n+second"


@query("SELECT 'new line|second' AS added")
def diff_added_lines(t):
    return t.values([(_DIFF,)], "diff string").select(F.array_join(x.diff_added(F.col("diff")), "|").alias("added"))


_FIXES = [
    (1, "TypeError", "x", "src/user_store.py", 7, "+if user is not None:", "", "Null Guard in UserStore", "backend.core", "user_store,typeerror,guard,null-safety"),
    (2, "KeyError", "'id'", "src/cart.py", 3, "", "", "Safe Key Lookup in Cart", "", "cart,keyerror,mapping,key-error"),
    (3, "ZeroDivisionError", "division by zero", "src/mean.py", 4, "", "", "Non-Zero Divisor Guard in Mean", "", "mean,zerodivisionerror,math,division"),
    (4, "OddError", "odd", "src/odd-one.py", 2, "", "close the file first", "OddOne Fix: close the file first", "", "odd-one,odderror,fix"),
    (5, "IndexError", "list index out of range", "src/pick.py", 9, "+if i < len(items):", "", "Bounds Guard in Pick", "", "pick,indexerror,bounds,indexing"),
    (6, "OddError", "odd", "src/plain.py", 1, "", "", "OddError Prevention in Plain", "", "plain,odderror,resilience"),
    (7, "IndentationError", "expected a block", "src/gen.py", 5, "+    pass", "", "Empty Block Invariant in Gen", "", "gen,indentationerror,ast,syntax,invariant"),
    (8, "ValueError", "bad", "src/parse.py", 6, "+try:\n+except ValueError:", "", "Defensive Exception Handling in Parse", "", "parse,valueerror,resilience,exceptions"),
]
_TEXTS = {2: "Use .get('id', default) or verify key presence in mapping before accessing in src/cart.py.", 4: "Prevent OddError in src/odd-one.py: close the file first", 6: "Address root cause in src/plain.py:1 to prevent OddError (odd)."}


@query("SELECT CAST(n AS BIGINT) AS n, name, tags, content FROM " + values_sql([(f[0], f[7], f[9], _TEXTS.get(f[0], "")) for f in _FIXES], "n, name, tags, content"))
def lesson_synthesis(t):
    got = errors.lessons(t.values([f[:7] for f in _FIXES], "n long, error_type string, error_message string, file string, line int, diff string, fix string"))
    return got.select("n", "name", F.array_join("tags", ",").alias("tags"), F.when(F.col("n").isin(*_TEXTS), F.col("content")).otherwise("").alias("content"))


_PY = '''"""Module."""
import os
import numpy.linalg as la
from .store import Thing
from . import helper
from shop.cart import Cart

class Box(Base, pkg.Other):
    """A box.

    More."""
    def __init__(self, a: int, b=2): pass
    async def open(self) -> str:
        """Opens it."""
        return ""
    def _hidden(self): pass

def total(items: list, tax: float, a, b, c) -> float:
    return 0.0
'''
_PY_ENTITIES = [("class", "Box", "class Box(Base, pkg.Other) [methods: __init__, open]", "A box.", 8), ("method", "Box.__init__", "def __init__(self, a: int, b)", "", 12), ("method", "Box.open", "async def open(self) -> str", "Opens it.", 13), ("function", "total", "def total(items: list, tax: float, a, b) -> float", "", 18)]


@query("SELECT entity_type, name, signature, docstring, CAST(line_number AS BIGINT) AS line_number FROM " + values_sql(_PY_ENTITIES, "entity_type, name, signature, docstring, line_number"))
def parse_python(t):
    files = t.values([("src/box.py", "Python", _PY)], "path string, language string, text string")
    return parse.symbols(parse.parsed(files)).select("entity_type", "name", "signature", "docstring", F.col("line_number").cast("long").alias("line_number"))


_CODE = [
    ("a.ts", "TypeScript", "import { x } from './x';\nexport class Cart extends Base {\n  add(item: string): void {\n    if (item) { this.n++; }\n  }\n}\nexport const total = async (a: number): number => a;\nexport function make(n) { return n; }\n"),
    ("b.go", "Go", 'package b\nimport "fmt"\nfunc (s *Store) Get(key string) string {\n\treturn ""\n}\nfunc Open(path string) error { return nil }\n'),
    ("c.rs", "Rust", "use crate::store::Db;\nuse serde::Value;\npub fn load(path: str) -> Value { todo!() }\ntrait Shape { }\n"),
    ("d.java", "Java", "import java.util.List;\npublic class Box {\n  public int size() { return 0; }\n  private static String name(int a) { return null; }\n}\n"),
]
_CODE_ENTITIES = [
    ("a.ts", "class", "Cart", 2), ("a.ts", "method", "Cart.add", 3), ("a.ts", "arrow_function", "total", 7), ("a.ts", "function", "make", 8), ("b.go", "method", "Store.Get", 3), ("b.go", "function", "Open", 6),
    ("c.rs", "function", "load", 3), ("c.rs", "class", "Shape", 4), ("d.java", "class", "Box", 2), ("d.java", "method", "Box.size", 3), ("d.java", "method", "Box.name", 4),
]


@query("SELECT path, entity_type, name, CAST(line_number AS BIGINT) AS line_number FROM " + values_sql(_CODE_ENTITIES, "path, entity_type, name, line_number"))
def parse_regex_langs(t):
    files = t.values(_CODE, "path string, language string, text string")
    return parse.symbols(parse.parsed(files)).select("path", "entity_type", "name", F.col("line_number").cast("long").alias("line_number"))


@query("SELECT path, inner_ones, outer_ones FROM " + values_sql([("src/box.py", "helper,shop.cart,store", "numpy"), ("a.ts", "./x", ""), ("b.go", "", "fmt"), ("c.rs", "crate::store::Db", "serde"), ("d.java", "", "java")], "path, inner_ones, outer_ones"))
def file_imports(t):
    files = t.values([("src/box.py", "Python", _PY), *_CODE], "path string, language string, text string")
    modules = parse.module_names(t.values([("src/shop/cart.py",), ("src/box.py",)], "path string"))
    got = parse.classified(parse.parsed(files), modules)
    return got.select("path", F.array_join("imports_internal", ",").alias("inner_ones"), F.array_join("imports_external", ",").alias("outer_ones"))


_FOLDED_PY = '"""Module."""\nimport os\nimport numpy.linalg as la\nfrom .store import Thing\nfrom . import helper\nfrom shop.cart import Cart\n\nclass Box(Base, pkg.Other):\n    """A box.\n\n    More."""\n\n    def __init__(self, a: int, b=2):\n        pass\n\n    async def open(self) -> str:\n        """Opens it."""\n        ... [L15-L15]\n\n    def _hidden(self):\n        pass\n\ndef total(items: list, tax: float, a, b, c) -> float:\n    ... [L19-L19]'


@query("SELECT skeleton, CAST(tier AS BIGINT) AS tier FROM " + values_sql([(_FOLDED_PY, 1)], "skeleton, tier"))
def skeleton_python(t):
    return skeleton.skeletons(t.values([(_PY, "python")], "text string, language string")).select("skeleton", F.col("tier").cast("long").alias("tier"))


_FOLDED_CODE = [
    ("a.ts", "import { x } from './x';\nexport class Cart extends Base {\n  add(item: string): void {\n      ... [L4-L4]\n  }\n}\nexport const total = async (a: number): number => a;\nexport function make(n) {\n    ... [L8-L8]\n}\n"),
    ("b.go", 'package b\nimport "fmt"\nfunc (s *Store) Get(key string) string {\n    ... [L4-L4]\n}\nfunc Open(path string) error {\n    ... [L6-L6]\n}\n'),
]


@query("SELECT path, skeleton FROM " + values_sql(_FOLDED_CODE, "path, skeleton"))
def skeleton_brace(t):
    files = t.values([(c[0], c[1].lower(), c[2]) for c in _CODE[:2]], "path string, language string, text string")
    return skeleton.skeletons(files).select("path", "skeleton")


_TALL = 'class Big:\n    """First line of it.\n\n    ' + "Much more text about it. " * 4 + '"""\n' + "".join(f'    def _m{i}(self, a, b):\n        """Helps number {i} with a few words."""\n        return a + b\n' for i in range(4)) + '    def run(self):\n        """Runs."""\n        return self._m0(1, 2)\n'


@query("SELECT CAST(budget AS BIGINT) AS budget, CAST(tier AS BIGINT) AS tier FROM " + values_sql([(2000, 1), (125, 2), (60, 3), (30, 4), (5, 4)], "budget, tier"))
def skeleton_tiers(t):
    out = None
    for budget in (2000, 125, 60, 30, 5):
        one = skeleton.skeletons(t.values([(_TALL, "python")], "text string, language string"), budget).select(F.lit(budget).cast("long").alias("budget"), F.col("tier").cast("long").alias("tier"))
        out = one if out is None else out.unionByName(one)
    return out


_BLOCKS = [
    (1, "a\n<s>\nold\n<e>\nb\n", "a\n<s>\nnew\n<e>\nb\n"),
    (2, "see `<s>` here\n<s>\nx\n<e>\n<s>\nlast\n<e>", "see `<s>` here\n<s>\nx\n<e>\n<s>\nnew\n<e>\n"),
    (3, "plain", "plain\n\n## Learned\n<s>\nnew\n<e>\n"),
    (4, "", "## Learned\n<s>\nnew\n<e>\n"),
]


@query("SELECT CAST(n AS BIGINT) AS n, text FROM " + values_sql([(b[0], b[2]) for b in _BLOCKS], "n, text"))
def inject_block(t):
    rows = t.values([b[:2] for b in _BLOCKS], "n long, text string")
    return rows.select("n", sinks.injected(F.col("text"), "<s>", "<e>", "new", "## Learned").alias("text"))


#: Budgets, and what is shown within them of 25 far and 12 near consumers and 10 targets (-1: not
#: even the line), worked out by hand from the lengths of the lines.
_BUDGETS = [(1, 250), (2, 150), (3, 112), (4, 85), (5, 60), (6, 10)]
_SHOWN = [(1, 25, 12, 10), (2, 2, 12, 10), (3, 0, 2, 10), (4, 0, 0, 3), (5, -1, -1, 0), (6, -1, -1, -1)]


@query("SELECT CAST(n AS BIGINT) AS n, CAST(t AS BIGINT) AS far, CAST(d AS BIGINT) AS near, CAST(a AS BIGINT) AS own FROM " + values_sql(_SHOWN, "n, t, d, a"))
def compaction_schedule(t):
    names = lambda p, n: [f"{p}_{i:02d}.py" for i in range(n)]
    base = ("HIGH", "git", "pytest -v tests/t.py", 100, names("src/t", 10), names("src/d", 12), names("src/far", 25), ["tests/t.py"], [])
    out = None
    for n, budget in _BUDGETS:
        rows = t.values([(n, *base)], "n long, impact string, source string, command string, total_files int, targets array<string>, direct array<string>, transitive array<string>, tests array<string>, symbols array<string>")
        got = render.compacted(rows, budget)
        shown = lambda label, whole: F.when(~F.col("text").contains(f"{label}: "), -1).otherwise(F.size(F.regexp_extract_all(F.regexp_extract("text", rf"(?m)^{label}: (.*)$", 1), F.lit(r"([a-z/_0-9]+\.py)"), F.lit(1)))).cast("long")
        one = got.select("n", shown("transitive_consumers", 25).alias("far"), shown("direct_consumers", 12).alias("near"), shown("targets", 10).alias("own"))
        out = one if out is None else out.unionByName(one)
    return out


_FOCUSED = "import os\n\n\ndef keep(a):\n    b = a + 1\n    return b\n\n\ndef fold(a):\n    b = a + 2\n    return b\n"
_FALLBACK = "def broken(:\n    a = 1\n    return a\n"
#: What stands in the tree for the focused function is no definition, so no empty line comes before it.
_FALLEN = [(1, "import os\ndef keep(a):\n    b = a + 1\n    return b\n\ndef fold(a):\n    ... [L10-L11]", 0), (2, "def broken(:\n    ... [L2-L3]", 1), (3, "import os\n\ndef keep(a):\n    ... [L5-L6]\n\ndef fold(a):\n    ... [L10-L11]", 1)]


@query("SELECT CAST(n AS BIGINT) AS n, skeleton, warned FROM " + values_sql(_FALLEN, "n, skeleton, warned"))
def skeleton_focus(t):
    """A focused function verbatim, a file that does not parse folded by indents, and a focus that is not there."""
    files = t.values([(1, _FOCUSED, "python", "keep"), (2, _FALLBACK, "python", None), (3, _FOCUSED, "python", "gone")], "n long, text string, language string, focus string")
    return skeleton.skeletons(files).select("n", "skeleton", F.col("warning").isNotNull().cast("int").alias("warned"))


_DISTILL = [
    (1, 'Traceback (most recent call last):\n  File "src/cart.py", line 9, in pay\n    return row["id"]\nKeyError: \'id\'', None, None, "KeyError", "src/cart.py", 9, "Safe Key Lookup in Cart", "cart,keyerror,mapping,key-error"),
    (2, "FAILED tests/test_mean.py::test_mean - ZeroDivisionError: division by zero\nsrc/mean.py:4: in mean\n    return total / n", None, None, "ZeroDivisionError", "src/mean.py", 4, "Non-Zero Divisor Guard in Mean", "mean,zerodivisionerror,math,division"),
    (3, 'Traceback (most recent call last):\n  File "src/user_store.py", line 3, in load\nTypeError: bad', "+if user is not None:", None, "TypeError", "src/user_store.py", 3, "Null Guard in UserStore", "user_store,typeerror,guard,null-safety"),
    (4, "panic: runtime error: index out of range [3]\n\ngoroutine 1 [running]:\nmain.pick(0x1)\n\t/srv/pick.go:12 +0x1d\n", None, "check the length", "IndexOutOfRange", "/srv/pick.go", 12, "Pick Fix: check the length", "pick,indexoutofrange,fix"),
]


@query("SELECT CAST(n AS BIGINT) AS n, error_type, file, CAST(line AS BIGINT) AS line, name, tags FROM " + values_sql([(d[0], *d[4:]) for d in _DISTILL], "n, error_type, file, line, name, tags"))
def distill_pipeline(t):
    logs = t.values([d[:4] for d in _DISTILL], "n long, log string, diff string, fix string")
    return errors.distilled(logs).select("n", "error_type", "file", F.col("line").cast("long").alias("line"), "name", F.array_join("tags", ",").alias("tags"))


_GENOME = genome.Genome(languages=[("Python", 3), ("Go", 1)], entry_points=["main.py"], modules=["src"], build_system="cargo", files=4, lines=1234, packages=["numpy"], hotspots=[("shop.cart", 2)], classes=["class Cart [a.py:1]"], functions=["def total [a.py:9]", "def load [b.py:3]"], paradigms=["async/await"], todos=["a.py:4 [TODO] x"])
_MAP = [
    (1, "[ARCHITECTURE_DNA]\nlangs: Python(3), Go(1)\nentry_points: main.py\nmodules: src\nbuild_test: build=cargo | test=none\nmetrics: 4 files, 1,234 lines"),
    (2, "[DEPENDENCY_MATRIX]\nexternal: numpy\nhotspots: shop.cart(2)"),
    (3, "[API_REGISTRY]\nclasses:\n  • class Cart [a.py:1]\nfunctions:\n  • def total [a.py:9]\n  • def load [b.py:3]"),
    (4, "[PATTERN_STANDARDS]\nconventions: snake_case-functions, PascalCase-classes, type-annotated\nparadigms: async/await"),
    (5, "[EVOLUTION_HOTSPOTS]\ntodo_markers:\n  • a.py:4 [TODO] x"),
]


@query("SELECT CAST(n AS BIGINT) AS n, block FROM " + values_sql(_MAP, "n, block"))
def genome_blocks(t):
    """The blocks of a project's map, as its compact text has them after the heading."""
    return t.values(list(enumerate(_GENOME.compact(1500).split("\n\n")[1:], 1)), "n long, block string")
