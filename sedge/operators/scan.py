"""Selection, upsert and change detection over file tables: all set-wise, no driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import exprs as x

# Extensions that are parsed, with the name of their language; folders that are
# skipped; stems of files by which a program starts.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "jsx": "React JSX", "ts": "TypeScript", "tsx": "React TSX", "java": "Java", "go": "Go", "rs": "Rust",
    "c": "C", "cpp": "C++", "h": "C/C++ Header", "hpp": "C++ Header", "cs": "C#",
}
IGNORED = {
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", "target", ".idea", ".vscode", ".gemini",
    "coverage", ".next", ".nuxt", "bin", "obj", ".pytest_cache", "vendor", "out", ".turbo",
}
ENTRY_NAMES = ["main", "app", "index", "server", "run", "start", "__main__", "cli", "wsgi", "asgi"]
MAX_BYTES = 500 * 1024


def outside(files: DataFrame, ignored: set[str] = IGNORED) -> DataFrame:
    """Rows of files whose path has no ignored folder and none that starts with a dot."""
    folders = F.split("path", "/")
    folders = F.slice(folders, F.lit(1), F.size(folders) - 1)
    return files.filter(~F.exists(folders, lambda d: d.isin(*sorted(ignored)) | d.startswith(".")))


def select_files(files: DataFrame, ignored: set[str] = IGNORED, max_files: int = 10_000) -> DataFrame:
    """Rows of files whose extension is known, outside ignored and dot folders, not minified by
    name; the first max_files by path."""
    kept = outside(files, ignored).filter(x.suffix(F.col("path")).isin(*LANGUAGES) & ~F.col("path").rlike(r"\.min\.(js|css)$"))
    return kept.orderBy("path").limit(max_files)


def is_minified(text, lines):
    """One line of over 300 characters, or lines of over 250 on average."""
    n = F.length(text)
    return ((lines <= 1) & (n > 300)) | ((lines > 1) & (n / lines > 250))


def is_entry(path):
    """The stem is an entry name, or `name.` is anywhere in the lower-cased path."""
    p = F.lower(x.slashes(path))
    stem = F.regexp_replace(x.file_name(p), r"(.)\.[^.]*$", "$1")
    return stem.isin(*ENTRY_NAMES) | x.contains_any(p, [f"{n}." for n in ENTRY_NAMES])


def upsert(existing: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """batch, and the rows of existing whose key it does not bring."""
    return existing.join(batch.select(key), key, "left_anti").select(*existing.columns).unionByName(batch.select(*existing.columns))


def lookup(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cached rows whose path and time both are as wanted (path, mtime)."""
    return cache.join(wanted, ["path", "mtime"], "left_semi")


def pruned(cache: DataFrame, active: DataFrame) -> DataFrame:
    """Cached rows whose path is still active."""
    return cache.join(active, "path", "left_semi")


def changes(cache: DataFrame, now: DataFrame) -> DataFrame:
    """path, status of what was deleted, touched (times differ by over 1e-4) or added."""
    both = cache.select("path", F.col("mtime").alias("was")).join(now.select("path", F.col("mtime").alias("now")), "path", "full_outer")
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.abs(F.col("was") - F.col("now")) > 1e-4, "touched")
    return both.select("path", status.alias("status")).filter(F.col("status").isNotNull())


def porcelain(lines: DataFrame) -> DataFrame:
    """Distinct paths of the column `line` of a short git status; a rename gives both its paths."""
    usable = lines.filter((F.length(F.trim("line")) > 0) & (F.length("line") >= 3) & ~F.col("line").startswith("!!"))
    paths = F.explode(F.split(F.substring("line", 4, 1 << 30), " -> "))
    return usable.select(paths.alias("raw")).select(F.regexp_replace(F.trim("raw"), '^"|"$', "").alias("path")).filter("path <> ''").distinct()


# Files that make a folder a package, most telling first.
INDICATORS = [("package.json", "Node/JS/TS"), ("Cargo.toml", "Rust"), ("go.mod", "Go"), ("pom.xml", "Java (Maven)"), ("build.gradle", "Java/Kotlin (Gradle)"), ("pyproject.toml", "Python"), ("setup.py", "Python"), ("requirements.txt", "Python"), ("CMakeLists.txt", "C/C++")]


def packages(paths: DataFrame) -> DataFrame:
    """name, rel_path, kind of the packages among the column `path`; of folders with one base name
    the first by path counts."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    rank = F.create_map(*[F.lit(v) for i, (n, _) in enumerate(INDICATORS) for v in (n, i)])
    kind = F.create_map(*[F.lit(v) for n, k in INDICATORS for v in (n, k)])
    name = x.file_name(F.col("path"))
    found = paths.select(folder.alias("rel_path"), name.alias("file")).filter(F.col("file").isin(*[n for n, _ in INDICATORS]))
    best = found.groupBy("rel_path").agg(F.min_by("file", rank[F.col("file")]).alias("file"))
    named = best.select(F.when(F.col("rel_path") == "", "root").otherwise(F.substring_index("rel_path", "/", -1)).alias("name"), "rel_path", kind[F.col("file")].alias("kind"))
    return named.groupBy("name").agg(F.min("rel_path").alias("rel_path"), F.min_by("kind", "rel_path").alias("kind"))


TODO = r"(?i)#\s*(TODO|FIXME|NOTE|BUG):\s*(.*)"


def todo_markers(files: DataFrame, limit: int = 5, lines: int = 200) -> DataFrame:
    """path, line, kind, note of the first markers within the first lines of each file."""
    each = files.select("path", F.posexplode(F.slice(F.split("text", "\n"), 1, lines)).alias("at", "body"))
    hits = each.select("path", (F.col("at") + 1).cast("long").alias("line"), F.upper(F.regexp_extract("body", TODO, 1)).alias("kind"), F.trim(F.regexp_extract("body", TODO, 2)).alias("note"))
    return hits.filter("kind <> ''").orderBy("path", "line").limit(limit)

