"""Texts that keep a token budget. Four characters count as a token."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(lines: DataFrame, line: str, tokens: int, by: list[str], *order: Column) -> DataFrame:
    """The first lines by order whose joined text has so many tokens at most (per group of by)."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    size = F.sum(F.length(line) + 1).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    return lines.withColumn("_size", size).filter(F.col("_size") < 4 * (tokens + 1)).drop("_size")


def shares(blocks: DataFrame, tokens: int) -> DataFrame:
    """block, budget: each block's share of the tokens by weight, its floor at least.

    blocks has a row for each block of a text: a handful.
    """
    total = blocks.agg(F.sum("weight").alias("total"))
    share = F.floor(tokens * (F.col("weight") / F.col("total"))).cast("long")
    return blocks.join(F.broadcast(total)).select("block", F.greatest(share, F.col("floor").cast("long")).alias("budget"))


def task_words(task: str) -> list[str]:
    """Distinct lower-cased words of a task of more than two characters."""
    return [w for w in dict.fromkeys(re.findall("[a-z0-9_]+", task.lower())) if len(w) > 2]


# Words that make a block of a project text weigh more.
BLOCK_WORDS = {
    "dna": ["setup", "build", "framework", "config", "install", "init", "architecture"],
    "deps": ["import", "package", "module", "dependency", "require", "library", "hotspot"],
    "patterns": ["pattern", "refactor", "style", "convention", "naming", "format", "async"],
    "evolution": ["fix", "bug", "issue", "todo", "error", "recent", "regression"],
}
BLOCK_FLOORS = {"dna": 80, "deps": 80, "apis": 120, "patterns": 60, "evolution": 60}


def block_weights(task: str, matched: bool) -> dict[str, int]:
    """A block weighs one more than the words of it that the task has; apis 3 if entities match."""
    words = set(re.findall("[a-z0-9_]+", task.lower()))
    found = {b: 1 + sum(w in words for w in ws) for b, ws in BLOCK_WORDS.items()}
    return {b: (3 if matched else 1) if b == "apis" else found[b] for b in BLOCK_FLOORS}


def halvings(n: Column) -> Column:
    """n, half of it rounded up, and so on to 1, then 0; only 0 for 0."""
    steps = F.when(n > 0, F.ceil(F.log2(n)).cast("int") + 1).otherwise(0)
    down = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), lambda k: F.ceil(n / F.pow(F.lit(2.0), k)).cast("int"))
    return F.when(n > 0, F.concat(down, F.array(F.lit(0)))).otherwise(F.array(F.lit(0)))


def schedule(targets: Column, direct: Column, transitive: Column, symbols: Column) -> Column:
    """The states of a report (symbols shown, transitive, direct, targets) from whole to smallest.

    -1 means that the section's line is gone. Consumers at a distance go first, then near ones,
    then targets; a later list starts to shrink when the one before shows nothing.
    """
    state = lambda s, t, d, a: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"), d.cast("int").alias("d"), a.cast("int").alias("a"))
    zero, gone = F.lit(0), F.lit(-1)
    whole = F.when(symbols > 0, F.array(state(F.lit(1), transitive, direct, targets), state(zero, transitive, direct, targets))).otherwise(F.array(state(zero, transitive, direct, targets)))
    far = F.transform(halvings(transitive), lambda k: state(zero, k, direct, targets))
    near = F.transform(halvings(direct), lambda k: state(zero, zero, k, targets))
    own = F.transform(halvings(targets), lambda k: state(zero, zero, zero, k))
    last = F.array(state(zero, gone, zero, zero), state(zero, gone, gone, zero), state(zero, gone, gone, gone))
    return F.concat(whole, far, near, own, last)


def section(label: str, names: Column, shown: Column) -> Column:
    """A line of the report, null if it has nothing to say or is dropped."""
    n = F.size(names)
    rest = F.concat(F.lit("(+"), (n - shown).cast("string"), F.lit(" more)"))
    body = F.when(shown >= n, F.array_join(names, ", ")).when(shown > 0, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(shown, F.lit(1))), ", "), F.lit(" "), rest)).otherwise(rest)
    return F.when((n > 0) & (shown >= 0), F.concat(F.lit(f"{label}: "), body))


def report_text(shown: Column) -> Column:
    """The text of an impact report whose columns are those of `compacted`, with so much shown."""
    head = F.format_string("[BLAST_RADIUS] Impact: %s | Targets: %d | Direct: %d | Transitive: %d | Source: %s", "impact", F.size("targets"), F.size("direct"), F.size("transitive"), "source")
    total = F.size("direct") + F.size("transitive")
    ratio = F.when(F.col("total_files") > 0, 100.0 * total / F.col("total_files")).otherwise(0.0)
    summary = F.format_string("summary: Fan-out ratio: %.1f%% (%d/%d files affected)", ratio, total, "total_files")
    tests = F.concat(F.lit("targeted_tests:\n"), F.when(F.size("tests") == 0, "  (none)").otherwise(F.array_join(F.transform("tests", lambda t: F.concat(F.lit("  • "), t)), "\n")))
    symbols = F.when((F.size("symbols") > 0) & (shown["s"] > 0), F.concat(F.lit("affected_symbols: "), F.array_join("symbols", "; ")))
    lines = F.array(head, summary, section("targets", F.col("targets"), shown["a"]), section("direct_consumers", F.col("direct"), shown["d"]), section("transitive_consumers", F.col("transitive"), shown["t"]), symbols, tests, F.concat(F.lit("recommended_test_command: "), "command"))
    return F.array_join(F.array_compact(lines), "\n")


def compacted(reports: DataFrame, tokens: int = 250) -> DataFrame:
    """reports with `text`: the fullest state that has so many tokens at most, else the smallest.

    reports has impact, source, command, total_files and the arrays targets, direct, transitive,
    tests and symbols ("file: names"). Heading, summary, tests and command are never cut.
    """
    sizes = [F.size(c) for c in ("targets", "direct", "transitive", "symbols")]
    texts = F.transform(schedule(*sizes), report_text)
    fit = F.get(F.filter(F.col("_texts"), lambda t: F.length(t) < 4 * (tokens + 1)), F.lit(0))
    return reports.withColumn("_texts", texts).withColumn("text", F.coalesce(fit, F.element_at("_texts", -1))).drop("_texts")


def trimmed_blocks(blocks: list[str], tokens: int) -> str:
    """Blocks joined by empty lines; over the budget all but the first are cut in proportion, back
    to a line's end."""
    whole = "\n\n".join(blocks)
    have = count_tokens(whole)
    if have <= tokens:
        return whole
    out = blocks[:1]
    for block in blocks[1:]:
        part = block[: max(int(len(block) * (tokens / have)), 50)]
        out.append(part[: part.rfind("\n")] if part.rfind("\n") > 0 else part)
    return "\n\n".join(out)


def count_tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def popped(lines: list[str], tokens: int, least: int = 2) -> str:
    """Lines without their last ones, until the text fits or so few are left."""
    lines = list(lines)
    while len(lines) > least and count_tokens("\n".join(lines)) > tokens:
        lines.pop()
    return "\n".join(lines)


def code_block(title: str, language: str, text: str, tokens: int) -> str:
    """A fenced block of code under its title: all lines, or as many as fit and a note that says so."""
    whole = [title, f"```{language}", *text.strip().split("\n"), "```"]
    if count_tokens("\n".join(whole)) <= tokens:
        return "\n".join(whole)
    tail = ["// ... [compacted for token budget]", "```"]
    return "\n".join([*leading(whole[:-1], 4 * (tokens + 1) - 1 - sum(len(t) + 1 for t in tail), 2), *tail])


def leading(lines: list[str], size: int, least: int = 0) -> list[str]:
    """The first lines whose joined text has so many characters at most, but so many lines at least."""
    ends = list(itertools.accumulate(len(line) + 1 for line in lines))
    return lines[: max(least, bisect_right(ends, size + 1))]


def closed(text: str, tokens: int) -> str:
    """The text if it fits, else its first lines with the code block closed that they leave open."""
    if count_tokens(text) <= tokens:
        return text
    lines = text.split("\n")
    kept = leading(lines, 4 * (tokens + 1) - 1)
    if "\n".join(kept).count("```") % 2:
        kept = leading(lines, 4 * (tokens + 1) - 1 - len("\n```"))
        kept = kept + ["```"] * ("\n".join(kept).count("```") % 2)
    return "\n".join(kept)
