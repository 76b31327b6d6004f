"""Queries whose SQL reads less than the whole tables, against brute force over all rows."""

import pytest

from sedge import plans
from tests.compare import rows
from tests.conftest import SF


def table(name: str, columns: list[str]) -> list[tuple]:
    import pyarrow.parquet as pq

    read = pq.read_table(f"{SF}/{name}.parquet", columns=columns)
    return list(zip(*(read.column(c).to_pylist() for c in columns)))


def got(spark, name: str) -> list[tuple]:
    df = plans.QUERIES[name](spark, SF)
    return rows(df.columns, df.collect())


@pytest.fixture(scope="module")
def edges():
    n = len(table("customer", ["c_custkey"]))
    return {(order % n, customer) for order, customer in table("orders", ["o_orderkey", "o_custkey"]) if order % n != customer}


@pytest.fixture(scope="module")
def levels(edges):
    """v: (level, is_test) of three levels from 7 and 11; tests are not walked on from."""
    is_test = {v: segment == "MACHINERY" for v, segment in table("customer", ["c_custkey", "c_mktsegment"])}
    found, frontier = {}, {7, 11}
    for level in (1, 2, 3):
        reached = {c for d, c in edges if d in frontier} - found.keys() - {7, 11}
        found |= {v: (level, is_test.get(v, False)) for v in reached}
        frontier = {v for v in reached if not is_test.get(v, False)}
    return found


def test_edges_of_all_orders(spark, edges):
    assert got(spark, "ingress_edges") == rows(["dep", "consumer"], edges)


def test_blast_walks_all_edges(spark, levels):
    assert got(spark, "blast_levels") == rows(["v", "level", "is_test"], [(v, n, int(t)) for v, (n, t) in levels.items()])
    assert got(spark, "blast_direct") == rows(["v"], [(v,) for v, (n, t) in levels.items() if n == 1 and not t])
    assert got(spark, "blast_transitive") == rows(["v"], [(v,) for v, (n, t) in levels.items() if n > 1 and not t])
    assert got(spark, "blast_tests") == rows(["test", "tier"], [(v, min(n, 2)) for v, (n, t) in levels.items() if t])


def test_blast_metrics_of_all_edges(spark, levels):
    n = len(table("customer", ["c_custkey"]))
    direct, total = (sum(not t and level <= most for level, t in levels.values()) for most in (1, 3))
    ratio = round(100 * total / n, 2)
    impact = "LOW" if not total or total <= 2 and ratio < 15 else "MEDIUM" if total <= 5 and ratio < 35 else "HIGH" if total <= 12 and ratio < 60 else "CRITICAL"
    assert got(spark, "blast_metrics") == rows(["total_files", "direct_fan_out", "total_fan_out", "fan_out_ratio", "impact"], [(n, direct, total, ratio, impact)])


def test_entities_in_all_turns(spark):
    want = [(c, turn, int(any(w in (text or "").lower() for w in ("the", "tion")))) for c, turn, text in table("conversations", ["conv_id", "turn", "text"])]
    assert any(turn > 0 and hit for _, turn, hit in want)
    assert got(spark, "task_entity_match") == rows(["conv_id", "turn", "hit"], want)


def test_compression_of_folded_texts(spark, tmp_path):
    """Skeletons written by hand: all of a text counts, not its first line."""
    python = "import os\n\n\ndef area(w, h):\n    size = w * h\n    print(size)\n    print(size)\n    print(size)\n    return size\n\n\nLIMIT = 10\n"
    go = "package a\n\nfunc Area(w int) int {\n\tsize := w * w\n\tsize += 1\n\tsize += 2\n\tsize += 3\n\tsize += 4\n\treturn size\n}\n"
    prose = "plain words\nand no code (at all).\n" * 5
    nested = "-" * 20000 + "1\n"
    folded = {
        "Python": [(python, "import os\n\ndef area(w, h):\n    ... [L5-L9]\nLIMIT = 10"), (nested, nested.rstrip())],
        "Go": [(go, "package a\n\nfunc Area(w int) int {\n    ... [L4-L9]\n}\n"), (prose, prose)],
        "Java": [(prose, prose)],
    }
    texts = [(text, {"Python": "en", "Go": "de", "Java": "es"}[language]) for language, pairs in folded.items() for text, _ in pairs]
    spark.createDataFrame([(i, text, lang, "src1", len(text)) for i, (text, lang) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES["compression_ratio"](spark, str(tmp_path))
    want = [(language, round(1 - sum(len(s) // 4 for _, s in pairs) / sum(len(text) // 4 for text, _ in pairs), 6)) for language, pairs in folded.items()]
    assert rows(df.columns, df.collect()) == rows(["language", "ratio"], want)


def test_cache_lookup_of_all_files(spark):
    ext = {"en": "py", "fr": "ts", "de": "go"}
    want = [(f"{source}/{lang}/doc_{doc}.{ext.get(lang, 'java')}", len(text)) for doc, source, lang, text in table("documents", ["doc_id", "source", "lang", "text"]) if doc % 4 != 1]
    assert got(spark, "cache_lookup") == rows(["path", "size"], want)
