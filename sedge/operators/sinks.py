"""Where results go: marked blocks in instruction files, and state as tables or JSON.

Texts are assembled from a few rows and written by the driver; tables are written by Spark.
"""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def injected(text: Column, start: str, end: str, body: str, heading: str = "") -> Column:
    """text with the body in its last block between the tags, where the tags stand alone on lines;
    else in the last block anywhere; else after the text, under the heading. A block starts at the
    last start before its end, so a start without an end takes no text with it."""
    s, e = (re.sub(r"([^\w\s])", r"\\\1", tag) for tag in (start, end))
    block = F.lit(f"{start}\n{body.strip()}\n{end}")
    text = F.coalesce(text, F.lit(""))
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))
    alone = rf"^[ \t]*{s}[ \t]*\r?$"
    whole, part = last(rf"(?smd){alone}.*?^[ \t]*{e}[ \t]*\r?$"), last(rf"(?s){s}.*?{e}")
    found = F.coalesce(F.regexp_extract(whole, rf"(?smd)\A.*({alone}.*)\z", 1), F.regexp_extract(part, rf"(?s)\A.*({s}.*)\z", 1))
    tail = _after_last(text, found)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(tail) - F.length(found))
    head, tail = F.regexp_replace(head, r"(\A|\n)[ \t]+\z", "$1"), F.regexp_replace(tail, r"\A[ \t]*\r?(?=\n|\z)", "")
    closed = lambda c: F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    under = F.concat(F.lit(f"{heading}\n" if heading else ""), block, F.lit("\n"))
    added = F.when(stripped != "", F.concat(stripped, F.lit("\n\n"), under)).otherwise(under)
    return F.when(found.isNotNull(), closed(F.concat(head, block, tail))).otherwise(added)


def _after_last(text: Column, part: Column) -> Column:
    """What follows the last place where the text has the part."""
    n = F.length(part)
    at = F.length(text) - n - F.instr(F.reverse(text), F.reverse(part)) + 2
    return F.substr(text, at + n)


def put_block(text: str, start: str, end: str, body: str, heading: str = "") -> str:
    """The same for one text in the driver."""
    block = f"{start}\n{body.strip()}\n{end}"
    alone = rf"^[ \t]*{re.escape(start)}[ \t]*\r?$"
    for begin, pattern in ((alone, rf"{alone}.*?^[ \t]*{re.escape(end)}[ \t]*\r?$"), (re.escape(start), f"{re.escape(start)}.*?{re.escape(end)}")):
        spots = [m.span() for m in re.finditer(pattern, text, re.S | re.M)]
        if not spots:
            continue
        first = max(m.start() for m in re.compile(begin, re.M).finditer(text, *spots[-1]))
        head, tail = re.sub(r"(\A|\n)[ \t]+\Z", r"\1", text[:first]), re.sub(r"\A[ \t]*\r?(?=\n|\Z)", "", text[spots[-1][1] :])
        out = head + block + tail
        return out if out.endswith("\n") else out + "\n"
    return "\n\n".join(filter(None, [text.strip(), "\n".join(filter(None, [heading, block]))])) + "\n"


def replace_atomically(path: Path, text: str) -> None:
    """Readers see the old or the new file, never a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.chmod(name, path.stat().st_mode & 0o777 if path.exists() else 0o644)
    os.replace(name, path)


def write_if_changed(path: Path, text: str) -> bool:
    """Leaves a file that has this text already as it is, its time included."""
    if path.is_file() and path.read_text(encoding="utf-8") == text:
        return False
    replace_atomically(path, text)
    return True


SECTIONS = ("genome", "lessons", "preferences")
TAGS = {s: (f"<!-- sedge:{s}:start -->", f"<!-- sedge:{s}:end -->") for s in SECTIONS}
_GUARDS = "### 🧬 Developer Preferences & Invariant Guards\n"
# The files of each target, the text of a new file, and for each section the heading
# and what stands before the body. A section without an entry has no place in that file.
TARGETS: dict[str, list[tuple[str, str, dict[str, tuple[str, str]]]]] = {
    "claude": [("CLAUDE.md", "# Claude Code Project Instructions\n", {"genome": ("## Architecture & Codebase Map", "### 🧬 Project AST Genome (<600 tokens)\n"), "lessons": ("## Learned Engineering Patterns", "### 🧬 Darwin Learned Best Practices\n"), "preferences": ("## Developer Preferences & Invariants", _GUARDS)})],
    "codex": [("AGENTS.md", "# OpenAI Codex & Agent Instructions\n", {"genome": ("## Architecture Context", "### 🧬 Repository AST Genome\n"), "lessons": ("## Operational Priors", "### 🧬 System Priors & Darwin Learnings\n"), "preferences": ("## Developer Preferences", _GUARDS)})],
    "antigravity": [(".agents/AGENTS.md", "# Antigravity Operating Ruleset\n", {"lessons": ("## Operational Rules", "### 🧬 Darwin Learned Patterns & Best Practices\n"), "preferences": ("## Developer Preferences", _GUARDS)})],
    "cursor": [(".cursorrules", "# Cursor Project Rules\n", {"genome": ("## Genome", ""), "lessons": ("## Learned Best Practices", ""), "preferences": ("## Developer Preferences", "")})],
    "windsurf": [(".windsurfrules", "# Windsurf Cascade Rules\n", {"genome": ("## Codebase Genome", ""), "lessons": ("## Verified Practices", ""), "preferences": ("## Developer Preferences", "")})],
}
PLAIN_GENOME = {"antigravity": ".agents/GENOME.md"}
RULES_FILE = ".cursor/rules/project_context.mdc"
RULES_HEAD = "---\ndescription: High-Density AST Genome and Darwin Patterns\nglobs: *\n---\n\n# Project Intelligence\n\n"
RULES_PARTS = {"genome": "## AST Codebase Genome", "lessons": "## Verified Operational Patterns", "preferences": "## Developer Preferences"}


def cleaned(section: str, text: str) -> str:
    """Without tags, blank lines and headings of its own; a genome is fenced as it is."""
    if section == "genome":
        return f"```\n{text.strip()}\n```"
    lines = (line.strip() for line in re.sub(r"<!--.*?-->", "", text, flags=re.S).splitlines())
    return "\n".join(line for line in lines if line and not line.startswith("#"))


def sync(target: str, root: Path, texts: dict[str, str]) -> dict[str, list[str]]:
    """Writes the sections (of SECTIONS) into the files of a target, or of all; returns the files."""
    target = target.strip().lower()
    if target != "all" and target not in TARGETS:
        raise ValueError(f"Unsupported target '{target}'. Choose from: {', '.join([*TARGETS, 'all'])}")
    texts = {s: t for s, t in texts.items() if t}
    done: dict[str, list[str]] = {}
    for name in TARGETS if target == "all" else [target]:
        files = []
        if name in PLAIN_GENOME and "genome" in texts:
            files.append(PLAIN_GENOME[name])
            write_if_changed(root / files[-1], texts["genome"].strip() + "\n")
        if name == "cursor" and texts:
            files.append(RULES_FILE)
            parts = [f"{RULES_PARTS[s]}\n{cleaned(s, texts[s])}\n" for s in SECTIONS if s in texts]
            write_if_changed(root / RULES_FILE, RULES_HEAD + "\n".join(parts))
        for file, fresh, places in TARGETS[name]:
            wanted = [s for s in SECTIONS if s in texts and s in places]
            if wanted:
                text = (root / file).read_text(encoding="utf-8") if (root / file).is_file() else fresh
                for s in wanted:
                    text = put_block(text, *TAGS[s], places[s][1] + cleaned(s, texts[s]), places[s][0])
                write_if_changed(root / file, text)
                files.append(file)
        done[name] = [str(root / f) for f in files]
    return done


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, written by the executors."""
    df.write.mode("overwrite").json(path)


def import_json(spark, path: str, schema: str) -> DataFrame:
    """Rows that parse; others are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", False).json(path)

