import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sedge.llm import common, fingerprint
from tests.conftest import SF
from tests.llm.tables import docs


def edited(rows):
    """doc_id -> edited text, by the definition."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        out[i] = t[: len(t) - half] + n[:half]
    return out


def check(spark, rows):
    got = {r.doc_id: r for r in fingerprint.fingerprinted(docs(spark, rows)).collect()}
    want = edited(rows)
    assert set(got) == set(want)
    assert {i: r.edited_text for i, r in got.items()} == want
    assert all(r.n_chars == len(dict(rows)[i] or "") for i, r in got.items())
    return got


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) for _ in range(n))


@pytest.mark.parametrize("ids", [range(700), range(0, 70_000, 100), [5], [1, 2], [-900, -1, 0, 7, 255, 256, 1 << 40, None], [3 * i * i for i in range(300)], [511, 512, 513]])
def test_edited_texts(spark, ids):
    check(spark, [(i, text(i or 0, 5 + (i or 0) % 7)) for i in ids])


def test_many_pairs_that_cells_keep_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "FEW", 5)
    check(spark, [(10**9 * i + i % 2, text(i, 9)) for i in range(90)])


def test_nulls_empty_long_and_equal_texts(spark):
    got = check(spark, [(1, None), (2, ""), (3, "one"), (4, "word " * 50_000), (5, "one"), (6, "ünïcode 𝄞 text")])
    assert got[3].sketch == got[5].sketch and got[1].sketch == [] == got[2].sketch


def test_repeated_ids(spark):
    got = fingerprint.fingerprinted(docs(spark, [(1, "aaaa"), (2, "zzzz"), (2, "bbbb"), (3, "cccc")])).collect()
    assert sorted((r.doc_id, r.edited_text) for r in got) == [(1, "aacc"), (2, "bbaa"), (2, "zzaa"), (3, "ccbb")]


def test_empty_table_and_clashing_columns(spark):
    assert fingerprint.fingerprinted(docs(spark, [])).collect() == []
    odd = docs(spark, [(1, "a b"), (2, "c d")]).withColumns({"k": F.lit(1), "cell": F.lit("x"), "sketch": F.lit(0)})
    assert len(fingerprint.fingerprinted(odd).collect()) == 2


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = edited(rows)
    found = fingerprint.op3_fingerprint(spark, SF).collect()
    assert len(found) == len(rows)
    assert all(r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def sets(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_estimates_are_close(spark):
    a, b = text(1, 3000), text(2, 3000)
    mixed = " ".join(a.split()[:2000] + b.split()[:1000])
    df = spark.createDataFrame([(a, mixed)], "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb")
    got = df.select(fingerprint.likeness(F.col("sa"), F.col("sb")).alias("j"), fingerprint.containment(F.col("sa"), F.col("sb")).alias("c"), fingerprint.merged(F.col("sa"), F.col("sb")).alias("m"), "sa", "sb").first()
    true = len(sets(a) & sets(mixed)) / len(sets(a) | sets(mixed))
    assert abs(got.j - true) < 0.08 and abs(got.c - len(sets(a) & sets(mixed)) / len(sets(a))) < 0.08
    assert got.m == sorted(set(got.sa) | set(got.sb))
