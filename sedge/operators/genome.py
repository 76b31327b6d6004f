"""A project's map in few words: languages, packages, declarations and notes, counted by Spark.

Every part is a top-k of an aggregate, so only as many rows as the text shows reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import render, scan

# External packages that show a framework, and files that show a build system.
FRAMEWORKS = [("fastapi", "FastAPI"), ("flask", "Flask"), ("django", "Django"), ("react", "React"), ("jsx", "React"), ("express", "Express"), ("next", "Next.js"), ("pytest", "Pytest")]
BUILD_FILES = [("pyproject.toml", "python-pip/setuptools"), ("setup.py", "python-pip/setuptools"), ("package.json", "npm/yarn"), ("Cargo.toml", "cargo"), ("go.mod", "go-modules")]
CONVENTIONS = ["snake_case-functions", "PascalCase-classes", "type-annotated"]
BUDGETS = {"dna": 350, "deps": 350, "apis": 400, "patterns": 200, "evolution": 200}


def totals(files: DataFrame) -> DataFrame:
    """One row: n files, their lines, and whether some path is one of tests (1 or 0; null without files)."""
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("total_lines"), F.lit(0)).alias("lines"), F.max(F.lower("path").rlike("unittest|test_").cast("int")).alias("tested"))


def modules(files: DataFrame, top: int = 10) -> DataFrame:
    """m: the first folders of paths."""
    return files.filter(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("m")).distinct().orderBy("m").limit(top)


def entry_points(files: DataFrame, top: int = 5) -> DataFrame:
    return files.filter("entry").orderBy("path").select("path").limit(top)


def internal_graph(imports: DataFrame, top: int = 5) -> DataFrame:
    """path, needs: the first internal imports of each file that has some."""
    return imports.filter(F.size("imports_internal") > 0).select("path", F.slice("imports_internal", 1, top).alias("needs"))


def paradigms(symbols: DataFrame) -> DataFrame:
    """One row: whether some function is async (a), whether some class is a dataclass (d); 1, 0 or null."""
    a = F.col("entity_type").isin("function", "arrow_function") & F.col("signature").contains("async def")
    d = (F.col("entity_type") == "class") & F.col("signature").contains("dataclass")
    return symbols.agg(F.max(a.cast("int")).alias("a"), F.max(d.cast("int")).alias("d"))


def build_system(names: list[str]) -> str:
    """By the first of the known files among those of the root."""
    return next((kind for name, kind in BUILD_FILES if name in names), "custom")


def languages(files: DataFrame, top: int = 5) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(top)


def hotspots(imports: DataFrame, top: int = 5) -> DataFrame:
    """imp, fan_in of the internal imports that the most files have."""
    return imports.select(F.explode("imports_internal").alias("imp")).groupBy("imp").agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "imp").limit(top)


def packages(imports: DataFrame, top: int = 20) -> DataFrame:
    return imports.select(F.explode("imports_external").alias("package")).distinct().orderBy("package").limit(top)


def frameworks(imports: DataFrame, known: list[tuple[str, str]] = FRAMEWORKS) -> DataFrame:
    """framework, of the known ones (signature, framework)."""
    known = imports.sparkSession.createDataFrame(known, "signature string, framework string")
    names = imports.select(F.explode("imports_external").alias("p")).select(F.lower("p").alias("signature")).distinct()
    return names.join(F.broadcast(known), "signature").select("framework").distinct().orderBy("framework")


def registry(symbols: DataFrame) -> DataFrame:
    """path, position, kind and the line of each class and function."""
    doc = F.when(F.col("docstring") != "", F.concat(F.lit(" - "), F.substring("docstring", 1, 40))).otherwise("")
    line = F.concat("signature", F.lit(" ["), "path", F.lit(":"), F.col("line_number").cast("string"), F.lit("]"), doc)
    return symbols.filter("entity_type <> 'method'").select("path", "position", F.when(F.col("entity_type") == "class", "class").otherwise("function").alias("kind"), line.alias("line"))


@dataclass
class Genome:
    languages: list[tuple[str, int]] = field(default_factory=list)
    frameworks: list[str] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)
    modules: list[str] = field(default_factory=list)
    build_system: str = "custom"
    test_framework: str = "none"
    files: int = 0
    lines: int = 0
    packages: list[str] = field(default_factory=list)
    hotspots: list[tuple[str, int]] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    paradigms: list[str] = field(default_factory=list)
    commits: list[str] = field(default_factory=list)
    todos: list[str] = field(default_factory=list)

    def block(self, name: str, tokens: int, commits: bool = False) -> str:
        listed = lambda label, items: [f"{label}: {', '.join(items)}"] if items else []
        bullets = lambda label, items: [label, *(f"  • {i}" for i in items)] if items else []
        lines = {
            "dna": ["[ARCHITECTURE_DNA]", *listed("langs", [f"{a}({n})" for a, n in self.languages[:5]]), *listed("frameworks", self.frameworks[:5]), *listed("entry_points", self.entry_points[:5]), *listed("modules", self.modules[:8]), f"build_test: build={self.build_system} | test={self.test_framework}", f"metrics: {self.files} files, {self.lines:,} lines"],
            "deps": ["[DEPENDENCY_MATRIX]", *listed("external", self.packages[:15]), *listed("hotspots", [f"{a}({n})" for a, n in self.hotspots])],
            "apis": ["[API_REGISTRY]", *bullets("classes:", self.classes[:15]), *bullets("functions:", self.functions[:20])],
            "patterns": ["[PATTERN_STANDARDS]", *listed("conventions", CONVENTIONS), *listed("paradigms", self.paradigms)],
            "evolution": ["[EVOLUTION_HOTSPOTS]", *(bullets("recent_commits:", self.commits) if commits else []), *bullets("todo_markers:", self.todos)],
        }[name]
        return render.popped(lines, tokens)

    @property
    def id(self) -> str:
        return hashlib.sha256("".join(self.block(b, BUDGETS[b]) for b in ("dna", "deps", "apis")).encode()).hexdigest()[:10]

    def compact(self, tokens: int = 1500) -> str:
        return render.trimmed_blocks([f"# PROJECT GENOME | id:{self.id}", *(self.block(b, n) for b, n in BUDGETS.items())], tokens)

    def task_context(self, task: str, tokens: int = 1200) -> str:
        """The parts that a task needs most, each with its share of the tokens."""
        words = render.task_words(task)
        near = lambda items: [i for i in items if any(w in i.lower() for w in words)]
        classes, functions = near(self.classes)[:8], near(self.functions)[:10]
        weights = render.block_weights(task, bool(classes or functions))
        share = {b: max(int(tokens * (w / sum(weights.values()))), render.BLOCK_FLOORS[b]) for b, w in weights.items()}
        api = self.block("apis", 350)
        if classes or functions:
            api = "\n".join(["[API_REGISTRY_RELEVANT]", *(["target_classes:", *(f"  • {c}" for c in classes)] if classes else []), *(["target_functions:", *(f"  • {f}" for f in functions)] if functions else [])])
        text = "\n\n".join([f"[SYNTHESIZED TASK CONTEXT | Task: {task[:80]}]", api, *(self.block(b, share[b], commits=True) for b in ("dna", "deps", "patterns", "evolution"))])
        return text if render.count_tokens(text) <= tokens else cut_at_line(text, tokens)


def cut_at_line(text: str, tokens: int) -> str:
    cut = text[: tokens * 4]
    return cut[: cut.rfind("\n")] if cut.rfind("\n") > 0 else cut


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame, root_files: list[str], notes: DataFrame | None = None, commits: list[str] = ()) -> Genome:  # type: ignore[assignment]
    """The map of files (path, language, total_lines, entry), their symbols and imports."""
    total = totals(files).first()
    lines = registry(symbols)
    first = lambda kind, top: [r.line for r in lines.filter(F.col("kind") == kind).orderBy("path", "position").limit(top).collect()]
    shown = paradigms(symbols).first()
    return Genome(
        languages=[(r.language, r.n) for r in languages(files).collect()],
        frameworks=[r.framework for r in frameworks(imports).collect()],
        entry_points=[r.path for r in entry_points(files).collect()],
        modules=[r.m for r in modules(files).collect()],
        build_system=build_system(root_files),
        test_framework="unittest/pytest" if total.tested else "none",
        files=total.n,
        lines=total.lines,
        packages=[r.package for r in packages(imports).collect()],
        hotspots=[(r.imp, r.fan_in) for r in hotspots(imports).collect()],
        classes=first("class", 200),
        functions=first("function", 200),
        paradigms=["async/await"] * bool(shown.a) + ["dataclasses-model"] * bool(shown.d),
        commits=list(commits),
        todos=[f"{r.path}:{r.line} [{r.kind}] {r.note}" for r in scan.todo_markers(notes).collect()] if notes is not None else [],
    )
