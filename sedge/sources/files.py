"""Source trees, git and state as DataFrames."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import exprs as x
from sedge.operators import scan


FILE = "path string, language string, text string, size bigint, mtime double, total_lines int, sha256 string, minified boolean, entry boolean"


def _relative(raw: DataFrame, root: str) -> DataFrame:
    base = str(root).split("://")[-1].rstrip("/") + "/"
    return raw.withColumns({"place": F.col("path"), "path": F.substr("path", F.instr("path", base) + F.lit(len(base)))})


def listed(spark: SparkSession, root: str, max_files: int = 10_000, ignored: set[str] = scan.IGNORED) -> DataFrame:
    """path (relative), place (as it is read) and mtime (seconds) of the files of the known extensions up to
    MAX_BYTES outside ignored and dot folders; the first max_files by path. No content is read."""
    glob = "*.{" + ",".join(scan.LANGUAGES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    inside = _relative(raw, root).filter((F.col("length") > 0) & (F.col("length") <= scan.MAX_BYTES))
    return scan.select_files(inside, ignored, max_files).select("path", "place", (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def source_files(spark: SparkSession, root: str, max_files: int = 10_000, ignored: set[str] = scan.IGNORED, cache: DataFrame | None = None) -> DataFrame:
    """path (relative), language, text, total_lines, size, mtime (seconds), sha256, minified, entry of what
    is listed, read by the executors; broken UTF-8 is replaced.

    Only files that the cache (path, mtime) does not have at their time are read.
    """
    wanted = listed(spark, root, max_files, ignored)
    places = [r.place for r in (wanted if cache is None else changed_only(wanted, cache)).select("place").collect()]  # max_files at most
    if not places:
        return spark.createDataFrame([], FILE)
    picked = _relative(spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in places]), root)
    language = F.create_map(*[F.lit(v) for kv in scan.LANGUAGES.items() for v in kv])[x.suffix(F.col("path"))]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = picked.select("path", language.alias("language"), text.alias("text"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    lines = F.size(F.split(F.regexp_replace("text", "(\r\n|\r|\n)$", ""), "\r\n|\r|\n"))
    rows = rows.withColumns({"total_lines": lines, "sha256": F.sha2("text", 256)})
    return rows.withColumns({"minified": scan.is_minified(F.col("text"), F.col("total_lines")), "entry": scan.is_entry(F.col("path"))})


def changed_only(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache (path, mtime) does not have at their time."""
    return files.join(cache.select("path", "mtime"), ["path", "mtime"], "left_anti")


def _git(root: Path, *args: str, timeout: int = 5) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_status(spark: SparkSession, root: str) -> DataFrame | None:
    """Paths that git calls changed; None without a repository here or in two folders above."""
    here = Path(root).resolve()
    if not any((p / ".git").exists() for p in [here, *list(here.parents)[:2]]):
        return None
    out = _git(here, "status", "--porcelain")
    return None if out is None else scan.porcelain(spark.createDataFrame([(line,) for line in out.splitlines()], "line string"))


def recent_commits(root: str, n: int = 5) -> list[str]:
    return (_git(Path(root), "log", "--oneline", "-n", str(n), timeout=3) or "").splitlines()[:n]


def noted_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the files whose markers are looked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,js,ts,java,md}").load(root)
    base = str(root).split("://")[-1].rstrip("/") + "/"
    return raw.select(F.substr("path", F.instr("path", base) + F.lit(len(base))).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
