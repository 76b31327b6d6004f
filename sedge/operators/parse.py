"""Classes, functions, methods and imports of source files: one file in, many rows out.

Syntax has no relational form, so files are parsed in Arrow batches; which imports are of the
project itself is then a join with the names of its modules.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Modules of Python's library that are no imports worth a name, keywords that look
# like methods, and patterns of declarations and imports.
STDLIB = set(
    "abc argparse ast asyncio base64 collections concurrent contextlib copy csv dataclasses datetime decimal difflib enum functools gc glob hashlib heapq hmac html http importlib inspect io itertools "
    "json logging math mimetypes multiprocessing os pathlib pickle platform pprint queue random re shutil signal socket sqlite3 ssl stat string struct subprocess sys tempfile textwrap threading time "
    "traceback typing unittest urllib uuid warnings weakref xml zipfile zlib".split()
)
KEYWORDS = set("if else for while switch catch finally return throw new typeof instanceof function class interface type import export from as try do with yield await case default".split())
CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|abstract\s+|final\s+|sealed\s+)*(?:class|interface|struct|trait|enum)\s+([A-Za-z0-9_]+)(?:<[^>]+>)?(?:\s+extends\s+([A-Za-z0-9_.]+))?"
RECEIVER = r"^\s*func\s+\(\s*(?:[A-Za-z0-9_]+\s+)?\*?(?P<owner>[A-Za-z0-9_]+)(?:\[[^\]]+\])?\s*\)\s+(?P<name>[A-Za-z0-9_]+)\s*\((?P<args>.*?)\)(?:\s*(?P<ret>[^{;\n]+))?"
FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:public\s+|static\s+|private\s+|protected\s+)*(?:function|fn|pub\s+fn|func)\s+(?P<name>[A-Za-z0-9_]+)(?:<[^>]+>)?\s*\((?P<args>.*?)\)(?:\s*(?:->|:)\s*(?P<ret>[A-Za-z0-9_<>\[\]]+))?"
ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z0-9_]+)\s*=\s*(?:async\s+)?\((?P<args>.*?)\)(?:\s*:\s*(?P<ret>[A-Za-z0-9_<>\[\]]+))?\s*=>"
SCRIPT_METHOD = r"^\s*(?:(?:public|private|protected|static|override|readonly|async)\s+)*(?:async\s+)?(?P<name>[A-Za-z0-9_]+)(?:<[^>]+>)?\s*\((?P<args>.*?)\)(?:\s*:\s*(?P<ret>[A-Za-z0-9_<>\[\]\s|&]+))?\s*\{"
JAVA_METHOD = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:public|protected|private)\s+(?:static\s+|final\s+|synchronized\s+|abstract\s+|default\s+)*(?:<[^>]+>\s+)?(?:(?P<ret>[A-Za-z0-9_<>\[\],\s]+?)\s+)?(?P<name>[A-Za-z0-9_]+)\s*\((?P<args>.*?)\)\s*(?:throws\s+[A-Za-z0-9_,\s]+)?\s*[{;]"
IMPORTS = [r"(?:from\s+|import\s*\(?)['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]", r"import\s+(?:static\s+)?([a-zA-Z0-9_.]+);"]
RUST_USE = r"use\s+([a-zA-Z0-9_:]+);"
SCRIPT_LANGUAGES = {"TypeScript", "React TSX", "JavaScript", "React JSX"}
METHOD_LANGUAGES = {"Java", "C#"}
#: At most so many imports of either kind count for a file that is not Python.
MOST_IMPORTS = 15

_TOKEN = re.compile(r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}]""", re.S)

Entity = dict


def _entity(kind: str, name: str, signature: str, line: int, doc: str = "") -> Entity:
    return {"entity_type": kind, "name": name, "signature": signature, "docstring": (doc.splitlines() or [""])[0], "line_number": line}


def _public(name: str) -> bool:
    return name in ("__init__", "__call__") or name[:1] != "_"


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    args = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in f.args.args]
    returns = f" -> {ast.unparse(f.returns)}" if f.returns else ""
    return f"{'async ' * isinstance(f, ast.AsyncFunctionDef)}def {f.name}({', '.join(args[:4])}){returns}"


def python_structure(code: str) -> tuple[list[Entity], list[tuple[str, str, bool]]]:
    """Entities and imports (name, top package, relative) of the top level and its classes; raises
    SyntaxError or ValueError."""
    entities, imports = [], []
    for node in ast.parse(code).body:
        match node:
            case ast.ClassDef():
                own = [f for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and _public(f.name)]
                bases = ", ".join(ast.unparse(b) for b in node.bases if isinstance(b, ast.Name | ast.Attribute))
                names = ", ".join(f.name for f in own[:4])
                entities.append(_entity("class", node.name, f"class {node.name}" + f"({bases})" * bool(bases) + f" [methods: {names}]" * bool(own), node.lineno, ast.get_docstring(node) or ""))
                entities += [_entity("method", f"{node.name}.{f.name}", _signature(f), f.lineno, ast.get_docstring(f) or "") for f in own]
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                if _public(node.name):
                    entities.append(_entity("function", node.name, _signature(node), node.lineno, ast.get_docstring(node) or ""))
            case ast.Import():
                imports += [(a.name, a.name.split(".")[0], False) for a in node.names]
            case ast.ImportFrom(module=None):
                imports += [(a.name, "", True) for a in node.names]
            case ast.ImportFrom():
                imports.append((node.module, node.module.split(".")[0], node.level > 0))
    return entities, [i for i in imports if i[1] not in STDLIB]


def class_spans(code: str, starts: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """First brace and end of the body of each class; strings and comments do not count."""
    spans = []
    for start, name in starts:
        first = code.find("{", start)
        if first < 0:
            continue
        depth, end = 0, len(code)
        for token in _TOKEN.finditer(code, first):
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if not depth:
                end = token.end()
                break
        spans.append((first, end, name))
    return spans


def brace_structure(code: str, language: str) -> tuple[list[Entity], list[tuple[str, str, bool]]]:
    """The same of languages with braces; also of Python that does not parse."""
    line = lambda m: code.count("\n", 0, m.start()) + 1
    found = list(re.finditer(CLASS, code, re.M))
    entities = [_entity("class", m[1], m[0].strip() + (f" extends {m[2]}" if m[2] else ""), line(m)) for m in found]
    spans = class_spans(code, [(m.start(), m[1]) for m in found])

    def owner(at: int) -> str:
        return next((name for first, end, name in reversed(spans) if first <= at < end), "")

    def declared(pattern: str):
        for m in re.finditer(pattern, code, re.M):
            if not m["name"].startswith("_"):
                yield m, f"{m['name']}({m['args'][:30]})", f" -> {m['ret'].strip()}" if m["ret"] and m["ret"].strip() else ""

    for m, call, returns in declared(RECEIVER):
        entities.append(_entity("method", f"{m['owner']}.{m['name']}", f"func ({m['owner']}) {call}{returns}", line(m)))
    for m, call, returns in declared(FUNCTION):
        entities.append(_entity("function", m["name"], call + returns, line(m)))
    for m, call, returns in declared(ARROW):
        entities.append(_entity("arrow_function", m["name"], f"{call}{returns} =>", line(m)))
    for languages, pattern, needs_owner in ((SCRIPT_LANGUAGES, SCRIPT_METHOD, True), (METHOD_LANGUAGES, JAVA_METHOD, False)):
        for m, call, returns in declared(pattern) if language in languages else ():
            within = owner(m.start())
            if m["name"] not in KEYWORDS and (within or not needs_owner):
                entities.append(_entity("method", f"{within}.{m['name']}" if within else m["name"], call + returns, line(m)))
    imports = []
    for imp in (i for pattern in IMPORTS for i in re.findall(pattern, code)):
        imports.append((imp, imp.split("/" if "/" in imp else ".")[0], imp.startswith((".", "/", "@/", "~/"))))
    for imp in re.findall(RUST_USE, code):
        top = imp.split("::")[0]
        imports.append((imp, top, top in ("crate", "super", "self")))
    return entities, imports


def structure(code: str, language: str) -> tuple[list[Entity], list[tuple[str, str, bool]]]:
    if language == "Python":
        try:
            return python_structure(code)
        except (SyntaxError, ValueError):
            pass
    return brace_structure(code, language)


ENTITIES = "array<struct<entity_type:string,name:string,signature:string,docstring:string,line_number:int>>"
IMPORTED = "array<struct<imp:string,top:string,relative:boolean>>"


def parsed(files: DataFrame) -> DataFrame:
    """files (path, language, text and more) with entities and imports; null texts have none."""
    names = [c for c in files.columns if c not in ("entities", "imports")]
    schema = T.StructType([*files.select(*names).schema.fields, *T.StructType.fromDDL(f"entities {ENTITIES}, imports {IMPORTED}").fields])
    entity = pa.struct([(n, pa.int32() if n == "line_number" else pa.string()) for n in ("entity_type", "name", "signature", "docstring", "line_number")])
    imported = pa.struct([("imp", pa.string()), ("top", pa.string()), ("relative", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = [structure(t or "", lang or "") for t, lang in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist())]
            imports = [[dict(zip(("imp", "top", "relative"), i)) for i in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.list_(entity)), pa.array(imports, pa.list_(imported))], names=[*names, "entities", "imports"])

    return files.select(*names).mapInArrow(run, schema)


#: Folders that a project may have its sources in; each folder in packages, and its src, is one too.
ROOTS = ["src", "lib", "app", "packages"]


def module_names(files: DataFrame, roots: list[str] = [*ROOTS, "packages/*", "packages/*/src"]) -> DataFrame:  # noqa: B006
    """top: names that an import of the project itself can start with: folders and stems of source
    files right under the project or one of its source roots; * stands for a folder."""
    below = [F.when(F.col("path").rlike(p), F.regexp_replace("path", p, "")) for p in ("^" + re.escape(r).replace(r"\*", "[^/]+") + "/" for r in roots)]
    first = F.explode(F.array_compact(F.array("path", *below))).alias("p")
    return files.select(first).select(F.regexp_replace(F.substring_index("p", "/", 1), r"\.(py|ts|tsx|js|jsx|go|rs|java)$", "").alias("top")).distinct()


def classified(parsed_files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, imports_internal, imports_external (sorted, distinct; at most MOST_IMPORTS unless Python)."""
    each = parsed_files.select("path", F.explode("imports").alias("i")).select("path", "i.*").distinct()
    known = each.join(modules.select("top").distinct().withColumn("_known", F.lit(True)), "top", "left")
    inner = F.col("relative") | F.col("_known").isNotNull()
    sides = known.groupBy("path").agg(F.collect_set(F.when(inner, F.col("imp"))).alias("a"), F.collect_set(F.when(~inner, F.col("top"))).alias("b"))
    cut = lambda c: F.when(F.col("language") == "Python", F.array_sort(c)).otherwise(F.slice(F.array_sort(c), 1, MOST_IMPORTS))
    none = F.array().cast("array<string>")
    joined = parsed_files.select("path", "language").join(sides, "path", "left")
    return joined.select("path", cut(F.coalesce("a", none)).alias("imports_internal"), cut(F.coalesce("b", none)).alias("imports_external"))


def symbols(parsed_files: DataFrame) -> DataFrame:
    """A row for each entity: path, position, entity_type, name, container, simple_name, signature,
    docstring, line_number."""
    each = parsed_files.select("path", F.posexplode("entities").alias("position", "e")).select("path", "position", "e.*")
    container = F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise("")
    return each.withColumns({"container": container, "simple_name": F.substring_index("name", ".", -1)})


def hrefs(html: Column) -> Column:
    """The distinct targets of the links of a page, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))
