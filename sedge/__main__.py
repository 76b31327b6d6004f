"""Command line: python -m sedge [--root FOLDER] COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedge")
    top.add_argument("--root", default=".")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **aliases) -> None:
        p = sub.add_parser(name, **aliases)
        for names, how in arguments:
            p.add_argument(*names.split(), **how)

    number = lambda n: {"type": int, "default": n}
    command("boost", ("task", {}), ("--max-tokens", number(600)), aliases=["bootstrap"])
    command("init", ("--target", {"default": "all"}), ("--max-tokens", number(600)))
    command("search", ("query", {}), ("--limit", number(20)))
    command("symbol", ("query", {}), ("--type", {}), ("--exact", {"action": "store_true"}), ("--limit", number(50)), ("--path", {}))
    command("skeleton", ("path", {}), ("--focus", {}), ("--max-tokens", number(600)))
    command("blast", ("--file", {"action": "append"}), ("--symbol", {}), ("--depth", number(3)), ("--max-tokens", number(250)), ("--json", {"action": "store_true"}))
    command("distill", ("--file", {}), ("--diff", {}), ("--fix", {}), ("--scope", {}), ("--no-register", {"action": "store_true"}))
    command("genome", ("--task", {}), ("--max-tokens", {"type": int}), ("--save", {}))
    command("monorepo", ("--save", {}))
    command("memory", ("action", {"choices": ["register", "use", "search", "list", "evolve"]}), ("--name", {"default": "learning"}), ("--content", {"default": ""}), ("--type", {"default": "pattern"}), ("--scope", {}), ("--tags", {"nargs": "*"}), ("--id", {}), ("--failed", {"action": "store_true"}), ("--query", {"default": ""}), ("--half-life", {"type": float}))
    command("harness", ("action", {"choices": ["status", "feedback", "eval", "history"]}), ("--type", {"default": "preference"}), ("--content", {"default": ""}), ("--scope", {"default": "global"}))
    command("sync", ("--target", {"default": "all"}))
    command("serve", ("--profile", {"choices": ["standard", "full"], "default": "full"}))
    return top


def text_of(path: str | None) -> str | None:
    return None if path is None else sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8", errors="replace")


def run(a: argparse.Namespace, project) -> str:
    from sedge.engine import as_text, pretty
    from sedge.operators import memory

    match a.command:
        case "boost" | "bootstrap":
            return project.boost(a.task, a.max_tokens)
        case "init":
            return pretty(project.init(a.target, a.max_tokens))
        case "search":
            return as_text(project.search(a.query, a.limit), score=True)
        case "symbol":
            return as_text(project.find_symbols(a.query, a.type, a.exact, a.limit, a.path))
        case "skeleton":
            return project.skeleton(a.path, a.focus, a.max_tokens)[0]
        case "blast":
            report = project.impact(a.file, a.symbol, a.depth)
            return pretty(report) if a.json else project.impact_text(report, a.max_tokens)
        case "distill":
            return pretty(project.distill(text_of(a.file or "-"), text_of(a.diff), a.fix, a.scope, not a.no_register))
        case "genome" | "monorepo":
            text = project.package_map() if a.command == "monorepo" else project.genome.task_context(a.task, a.max_tokens or 1200) if a.task else project.genome.compact(a.max_tokens or 1500)
            if a.save:
                Path(a.save).write_text(text + "\n", encoding="utf-8")
            return text
        case "memory":
            if a.action == "register":
                return project.remember(a.name, a.content, a.type, a.scope or "global", a.tags)
            if a.action == "use":
                project.use(a.id, not a.failed)
                return a.id
            if a.action == "evolve":
                return pretty(project.evolve(half_life_days=a.half_life, rate=memory.DECAY))
            return "\n".join(project.recall(a.query, a.scope, a.tags, 10 if a.action == "search" else 1000))
        case "harness":
            if a.action == "feedback":
                return pretty(project.feedback(a.type, a.content, a.scope))
            return pretty(project.status()["recent_episodes"] if a.action == "history" else project.status())
        case "sync":
            return pretty(project.sync(a.target))
    raise SystemExit(f"unknown command {a.command}")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from sedge.engine import Project
    from sedge.operators.dispatch import Server

    spark = SparkSession.builder.appName("sedge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project = Project(spark, a.root)
    if a.command == "serve":
        for reply in Server(project, a.profile).serve(sys.stdin):
            print(reply, flush=True)
    else:
        print(run(a, project))


if __name__ == "__main__":
    main()
