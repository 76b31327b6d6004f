"""Source code folded to a skeleton: bodies give way to the range of lines that they had.

A text goes in and a text comes out, and the rules follow syntax trees, so this is an Arrow map. A
focus symbol keeps its whole source. Python that parses has four tiers, each shorter than the one
before; the first that keeps the budget counts.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.operators.render import count_tokens

BUDGET = 600
# The marks that folding leaves, words before parentheses that start no function, and
# patterns of declarations in languages with braces.
ELIDED = "... [L{}-L{}]"
COLLAPSED = "# ... [{} private methods collapsed]"
CONTROL = {"if", "for", "while", "switch", "catch", "with", "try", "synchronized", "using", "lock", "fixed"}
CONTAINER = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|abstract\s+)?\b(class|interface|enum)\b")
ARROW = re.compile(r"(?:(?:const|let|var)\s+)?([A-Za-z0-9_]+)\s*(?::[^=]+)?\s*=\s*(?:async\s*)?$")
BARE_ARROW = re.compile(r"(?:(?:const|let|var)\s+)?([A-Za-z0-9_]+)\s*(?::[^=]+)?\s*=\s*(?:async\s+)?(?:[A-Za-z0-9_]+)?$")
RECEIVER = re.compile(r"func\s*\(\s*(?:[A-Za-z0-9_]+\s+)?\*?([A-Za-z0-9_]+)\s*$")
NAME = re.compile(r"(?:([A-Za-z0-9_]+)::)?([A-Za-z0-9_]+)$")
DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+([A-Za-z0-9_]+)\b")
_PUNCTUATION = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*'?|"(?:\\.|[^"\\])*"?|`(?:\\.|[^`\\])*`?|[(){};]""", re.S)

_Def = ast.FunctionDef | ast.AsyncFunctionDef


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t"))]


def _is_text(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


class _Folder:
    """Folds one syntax tree. What ast.unparse cannot write stands in the tree as a name, and
    `marks` says which lines take its place at which indent."""

    def __init__(self, lines: list[str], focus: str | None, tier: int):
        self.lines, self.tier, self.found = lines, tier, False
        self.focus = focus.rstrip("()") if focus else ""
        self.marks: dict[str, object] = {}

    def mark(self, write) -> ast.stmt:
        name = f"__folded_{len(self.marks)}__"
        self.marks[name] = write
        return ast.Expr(ast.Name(name, ast.Load()))

    def wanted(self, name: str, owners: list[str]) -> bool:
        return bool(self.focus) and self.focus in (name, ".".join([*owners[-1:], name]), ".".join([*owners, name]))

    def holds_wanted(self, node: ast.AST, owners: list[str]) -> bool:
        if not self.focus:
            return False
        inner = (n.name for n in ast.walk(node) if n is not node and isinstance(n, _Def | ast.ClassDef))
        path = ".".join([*owners, node.name]) + "."
        return any(n == self.focus.rsplit(".", 1)[-1] or owners and (path + n).endswith(self.focus) for n in inner)

    def source(self, node: ast.stmt) -> ast.stmt:
        """The node's own lines, with decorators and the comments that trail its body."""
        self.found = True
        first = min([d.lineno for d in node.decorator_list] + [node.lineno])
        last = node.end_lineno
        depth = len(_indent(self.lines[node.lineno - 1]))
        for at in range(last, len(self.lines)):
            text = self.lines[at]
            if text.strip():
                if len(_indent(text)) <= depth or not text.lstrip().startswith("#"):
                    break
                last = at + 1
        raw = self.lines[first - 1 : last]
        base = _indent(next((r for r in raw if r.strip()), ""))

        def write(indent: str) -> Iterator[str]:
            shift = len(indent) - len(base)
            for r in raw:
                if not r.strip():
                    yield ""
                elif r.startswith(base):
                    yield indent + r[len(base) :].expandtabs(4)
                else:
                    yield (" " * shift + r if shift >= 0 else r[min(len(_indent(r)), -shift) :]).expandtabs(4)

        return self.mark(write)

    def doc(self, body: list[ast.stmt]) -> tuple[list[ast.stmt], list[ast.stmt]]:
        """The docstring as the tier keeps it, and the rest of the body."""
        if not body or not _is_text(body[0]):
            return [], list(body)
        if self.tier == 1:
            return [body[0]], list(body[1:])
        if self.tier == 2:
            first = (body[0].value.value.strip().splitlines() or [""])[0].strip()
            return [ast.Expr(ast.Constant(first))], list(body[1:])
        return [], list(body[1:])

    def block(self, body: list[ast.stmt], owners: list[str]) -> list[ast.stmt]:
        return [self.statement(s, owners) for s in body]

    def statement(self, node: ast.stmt, owners: list[str]) -> ast.stmt:
        if isinstance(node, _Def | ast.ClassDef):
            if self.wanted(node.name, owners):
                return self.source(node)
            return self.class_(node, owners) if isinstance(node, ast.ClassDef) else self.function(node, owners)
        for part in [node, *getattr(node, "handlers", []), *getattr(node, "cases", [])]:
            for field in ("body", "orelse", "finalbody"):
                if isinstance(inner := getattr(part, field, None), list):
                    setattr(part, field, self.block(inner, owners))
        return node

    def class_(self, node: ast.ClassDef, owners: list[str]) -> ast.stmt:
        owners = [*owners, node.name]
        doc, rest = self.doc(node.body)
        if self.tier >= 4:
            private = [f for f in rest if isinstance(f, _Def) and f.name.startswith("_") and not (f.name.startswith("__") and f.name.endswith("__")) and not self.wanted(f.name, owners) and not self.holds_wanted(f, owners)]
            if private:
                note = COLLAPSED.format(len(private))
                at = rest.index(private[0])
                rest[at] = self.mark(lambda indent: [indent + note])
                rest = [s for s in rest if s not in private[1:]]
                if len(doc) + len(rest) == 1:
                    rest.append(ast.Pass())
        node.body = doc + self.block(rest, owners) or [ast.Pass()]
        return node

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, owners: list[str]) -> ast.stmt:
        doc, rest = self.doc(node.body)
        if self.holds_wanted(node, owners):
            node.body = doc + self.block(rest, [*owners, node.name]) or [ast.Pass()]
        elif not rest:
            node.body = doc or [ast.Pass()]
        elif len(rest) == 1 and (isinstance(rest[0], ast.Pass) or isinstance(rest[0], ast.Expr) and isinstance(rest[0].value, ast.Constant) and rest[0].value.value is Ellipsis):
            node.body = doc + rest
        else:
            note = ELIDED.format(rest[0].lineno, max(rest[0].lineno, *(s.end_lineno or s.lineno for s in rest)))
            node.body = [*doc, self.mark(lambda indent: [indent + note])]
        return node

    def text(self, code: str) -> str:
        tree = ast.parse(code)
        tree.body = self.block(tree.body, [])
        out: list[str] = []
        for line in ast.unparse(ast.fix_missing_locations(tree)).splitlines():
            write = self.marks.get(line.strip())
            out += write(_indent(line)) if write else [line]
        return "\n".join(out)


def indentation_fold(code: str, focus: str | None) -> str:
    """The same for Python that does not parse, by indents alone."""
    lines, out, at = code.splitlines(), [], 0
    names = {focus.rstrip("()"), focus.rstrip("()").rsplit(".", 1)[-1]} if focus else set()
    blank = lambda i: not lines[i].strip()
    while at < len(lines):
        head = at
        while head < len(lines) and lines[head].strip().startswith("@"):
            head += 1
        m = DEF.match(lines[head]) if head < len(lines) else None
        if not m:
            out.append(lines[at])
            at += 1
            continue
        depth = len(m[1])
        colon, opened = head, 0
        while True:  # to the colon that ends the header, or to where parentheses are closed without one
            opened += lines[colon].count("(") - lines[colon].count(")")
            if lines[colon].rstrip().endswith(":") or colon + 1 >= len(lines) or not blank(colon + 1) and opened <= 0:
                break
            colon += 1
        first = end = colon + 1
        while end < len(lines) and (blank(end) or len(_indent(lines[end])) > depth):
            end += 1
        last = end - 1
        while last >= first and blank(last):
            last -= 1
        out += lines[at:first]
        if m[2] in names:
            out += lines[first:end]
        elif last >= first:
            out += _folded_body(lines, first, last, m[1] + "    ")
        at = end
    return "\n".join(out)


def _folded_body(lines: list[str], first: int, last: int, indent: str) -> list[str]:
    kept, rest = [], first
    quote = lines[first].strip()[:3]
    if quote in ('"""', "'''"):
        rest = first + 1
        if lines[first].strip().count(quote) < 2:
            while rest <= last and quote not in lines[rest]:
                rest += 1
            rest = min(rest, last) + 1
        kept = lines[first:rest]
    body = [t.strip() for t in lines[rest : last + 1] if t.strip()]
    if rest > last:
        return kept or [indent + "pass"]
    return [*kept, indent + (body[0] if body in (["pass"], ["..."]) else ELIDED.format(rest + 1, last + 1))]


def brace_fold(code: str, language: str, focus: str | None) -> tuple[str, bool]:
    """The text with folded function bodies, and whether the focus was found."""
    marks = [(m.start(), m[0]) for m in _PUNCTUATION.finditer(code) if len(m[0]) == 1 and m[0] in "(){};"]
    closer: dict[int, int] = {}
    opened: list[int] = []
    for i, (_, c) in enumerate(marks):
        if c == "{":
            opened.append(i)
        elif c == "}" and opened:
            closer[opened.pop()] = i
    wanted = (focus or "").rstrip("()").replace("::", ".")
    simple = wanted.rsplit(".", 1)[-1]
    go, receiver, found = language == "go", "", False
    depth, pending, i = 0, None, 0
    folds: list[tuple[int, int, str]] = []

    def line_before(at: int) -> str:
        return code[code.rfind("\n", 0, at) + 1 : at]

    while i < len(marks):
        at, c = marks[i]
        i += 1
        if c == "(":
            if depth == 0 and not CONTAINER.search(line_before(at)):
                before = _without_generics(code[:at].rstrip())
                indent = _indent(line_before(at))
                if m := ARROW.search(_last_lines(before)):
                    pending = (m[1], m[1], indent)
                elif (m := NAME.search(before)) and m[2] not in CONTROL and not (go and m[2] == "func"):
                    owner = m[1] or (receiver if go else "")
                    pending, receiver = (m[2], f"{owner}.{m[2]}" if owner else m[2], indent), ""
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
            if depth == 0 and go and not pending and (m := RECEIVER.search(_last_lines(code[:at]))):
                receiver = m[1]
        elif depth:
            continue
        elif c in ";}":
            pending = None
        else:
            before = code[:at].rstrip()
            if not pending and before.endswith("=>") and (m := BARE_ARROW.search(_last_lines(before[:-2].rstrip()))):
                pending = (m[1], m[1], _indent(line_before(at)))
            close = closer.get(i - 1)
            if not pending:
                continue
            (name, qualified, indent), pending = pending, None
            is_wanted = bool(wanted) and (wanted in (name, qualified) or simple == name)
            found |= is_wanted
            if close is None:
                continue
            body = code[at + 1 : marks[close][0]]
            if wanted and not is_wanted and re.search(rf"\b{re.escape(simple)}\b", body):
                continue  # the focus may be inside
            if body.strip() and not is_wanted:
                first = code.count("\n", 0, at + 1 + len(body) - len(body.lstrip())) + 1
                last = code.count("\n", 0, at + 1 + len(body.rstrip())) + 1
                folds.append((at + 1, marks[close][0], f"\n{indent}    {ELIDED.format(first, max(first, last))}\n{indent}"))
            i = close + 1
    out, done = [], 0
    for start, end, note in folds:
        out += [code[done:start], note]
        done = end
    return "".join([*out, code[done:]]), found


def _last_lines(text: str, chars: int = 2000) -> str:
    """The end of a text: a declaration is looked for backwards, not through the whole file."""
    return text[-chars:]


def _without_generics(text: str) -> str:
    if not text.endswith(">"):
        return text
    depth = 0
    for at in range(len(text) - 1, -1, -1):
        depth += {">": 1, "<": -1}.get(text[at], 0)
        if not depth:
            return text[:at].rstrip()
    return ""


def fold(code: str, language: str, focus: str | None = None, tokens: int = BUDGET) -> tuple[str, int, str | None]:
    """The skeleton, the tier that made it, and a warning or none."""
    missing = f"Focus symbol '{focus}' not found in source."
    if language == "python":
        lines = code.splitlines()
        try:
            for tier in (1, 2, 3, 4):
                folder = _Folder(lines, focus, tier)
                out = folder.text(code)
                if count_tokens(out) <= tokens:
                    break
            warnings = [missing] * bool(focus and not folder.found)
            warnings += [f"Skeleton exceeds max_tokens budget ({count_tokens(out)} > {tokens}) at Tier 4."] * (count_tokens(out) > tokens)
            return out, tier, " | ".join(warnings) or None
        except (SyntaxError, ValueError, MemoryError, RecursionError) as e:  # the last two: nested too deeply to parse
            return indentation_fold(code, focus), 1, f"SyntaxError in Python source ({e}); used indentation fallback."
    out, found = brace_fold(code, language, focus)
    warnings = [missing] * bool(focus and not found) + [f"Skeleton exceeds max_tokens budget ({count_tokens(out)} > {tokens})."] * (count_tokens(out) > tokens)
    return out, 1, " | ".join(warnings) or None


def skeletons(files: DataFrame, tokens: int = BUDGET) -> DataFrame:
    """files (text, language, focus or not) with skeleton, tokens, tier and warning.

    A null text is empty, a null language "generic". Columns of these names are replaced.
    """
    new = ["skeleton", "tokens", "tier", "warning"]
    names = [c for c in files.columns if c not in new]
    schema = T.StructType([*files.select(*names).schema.fields, *T.StructType.fromDDL("skeleton string, tokens int, tier int, warning string").fields])
    has_focus = "focus" in names

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            focus = batch.column("focus").to_pylist() if has_focus else [None] * batch.num_rows
            got = [fold(t or "", (lang or "generic").lower(), f, tokens) for t, lang, f in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist(), focus)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([count_tokens(g[0]) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], names=[*names, *new])

    return files.select(*names).mapInArrow(run, schema)


def cached(files: DataFrame, cache: DataFrame, tokens: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Skeletons of files (path, mtime, focus, text, language) and the grown cache (key, skeleton,
    tokens, tier, warning): only files without a row there are folded."""
    keyed = files.withColumn("key", F.sha2(F.concat_ws(":", "path", F.col("mtime").cast("string"), F.coalesce("focus", F.lit("")), F.lit(str(tokens))), 256))
    made = skeletons(keyed.join(cache.select("key"), "key", "left_anti"), tokens).select(*cache.columns)
    grown = cache.unionByName(made)
    return keyed.drop("text").join(grown, "key"), grown
