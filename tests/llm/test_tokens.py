import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedge.llm import bpe, common, packing, token_counts, tokens
from tests.conftest import SF
from tests.llm.tables import DOCS, docs

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "Hello, World!", "ΟΔΟΣ Σίσυφος", "é café Å", "don't we'll I'M", "a\x1cb\x1dc \x1e", "x" * 3000, "<|endoftext|>a<|startoftext|> b", "  x　", "日本語 テスト 한국어", "😀👍🏽 ok",
    "  lead and  double   spaces ", "tab\tand\nnew\r\nlines\n\n", "12345 3.14 1,000", "İstanbul ǅ ß ﬁ", "a" * 250 + "b", "\x00\x01 control", "…—“quoted”", "word " * 2000,
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def texts(spark):
    return [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_odd_texts():
    lib, mine = library(WORD), bpe.loaded(WORD)
    for t in ODD:
        assert np.frombuffer(mine.encode(t), "<i4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    lib, mine = library(BYTE), tokens.loaded(BYTE)
    for t in ODD:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_encode_whole_table(spark):
    lib = library(WORD)
    found = {r.doc_id: r for r in bpe.op6_bpe(spark, SF).collect()}
    rows = texts(spark)
    assert len(found) == len(rows)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = found[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_edges(spark):
    lib = library(WORD)
    rows = docs(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "again"), (3, "again")]).withColumns({"IDS": F.lit("x"), "decoded": F.lit(1)})
    out = bpe.decode(bpe.encode(rows, WORD), WORD).collect()
    assert len(out) == len(ODD) + 3
    for r in out:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(spark.createDataFrame([], DOCS), WORD).collect() == []


def test_section_counts_add_up(spark):
    lib = library(BYTE)
    found = token_counts.op7_token_counts(spark, SF).toPandas()
    for i, t in texts(spark):
        one = found[found.doc_id == i].sort_values("section")
        assert one.n_tokens.sum() == len(lib.encode(t or "", add_special_tokens=False).ids)
        assert one.start.tolist() == [0, *one.end.tolist()[:-1]] and one.end.tolist()[-1] == len(t or "")
        assert "".join((t or "")[a:b] for a, b in zip(one.start, one.end)) == (t or "")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_boundary_rule(rule):
    def slow(lengths, starts, end):
        out, at = [0] * len(starts), 0
        for n in lengths:
            share = [max(0, min(at + n, e) - max(at, s)) for s, e in zip(starts, [*starts[1:], end])]
            first = next(k for k, v in enumerate(share) if v)
            out[share.index(max(share)) if rule == "most" else first] += 1
            at += n
        return out

    r = np.random.default_rng(3)
    for _ in range(200):
        lengths = r.integers(1, 9, r.integers(1, 30))
        end = int(lengths.sum())
        starts = np.unique(np.concatenate([[0], r.integers(0, end, r.integers(0, 6))]))
        assert token_counts.allocate(lengths, starts, end, rule).tolist() == slow(lengths.tolist(), starts.tolist(), end)


def test_count_edges(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "a\n\nb\n"), (None, "x"), (3, "a\n\nb\n"), (4, "é\n日本\n<|endoftext|>")]).withColumn("section", F.lit(9))
    out = token_counts.count(rows, BYTE).collect()
    assert [(r.doc_id, r.section, r.n_tokens) for r in out if r.doc_id in (1, 2)] == [(1, 0, 0), (2, 0, 0)]
    assert len([r for r in out if r.doc_id == 3]) == 6
    assert token_counts.count(spark.createDataFrame([], DOCS), BYTE).collect() == []
    with pytest.raises(ValueError):
        token_counts.count(rows, BYTE, rule="other")


def naive_best_fit(lengths, size, most):
    """Bin and offset of each length: a list of open bins, looked through for each."""
    open_bins, out, made = [], [], 0  # (bin, used)
    for n in lengths:
        fits = [x for x in open_bins if size - x[1] >= n]
        if fits:
            used = max(x[1] for x in fits)
            b = [x for x in fits if x[1] == used][-1]
            open_bins.remove(b)
        else:
            b, made = (made, 0), made + 1
        out.append(b)
        open_bins.append((b[0], b[1] + n))
        if open_bins[-1][1] == size:
            open_bins.pop()
        if len(open_bins) > most:
            used = max(x[1] for x in open_bins)
            open_bins.remove([x for x in open_bins if x[1] == used][-1])
    return out


@pytest.mark.parametrize("most", [1, 3, 16, 64])
def test_bounded_best_fit_equals_the_naive_one(most):
    r = np.random.default_rng(most)
    for size, high in ((50, 51), (2048, 2049), (2048, 700)):
        lengths = r.integers(1, high, 1500).tolist()
        bins = packing.Bins(size, most)
        assert [bins.place(n) for n in lengths] == naive_best_fit(lengths, size, most)
        assert bins.most <= most


def test_the_bound_of_open_bins_is_reached(spark):
    r = np.random.default_rng(1)
    bins = packing.Bins()
    lengths = r.integers(1, packing.SIZE + 1, 3000).tolist()
    for n in lengths:
        bins.place(n)
    assert bins.most == packing.OPEN < bins.made
    cut = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").coalesce(1)
    assert [(r.sequence_id, r.offset) for r in packing.pack(cut, 3000).sort("doc_id").collect()] == naive_best_fit(lengths, packing.SIZE, packing.OPEN)


def check_packing(spark, found, rows):
    lib = library(BYTE)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
            assert k == 0 or r.length == packing.SIZE
        assert at == len(ids[i]) and (len(parts) == 1 or at > packing.SIZE)
    total = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
        total += at
    assert len(by_seq) <= 1.03 * -(-total // packing.SIZE) + 2


def test_pack_whole_table(spark):
    check_packing(spark, packing.op10_packing(spark, SF).collect(), texts(spark))


def test_pack_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "a"), (5, "x" * 9000), (6, "word " * 2047)]
    check_packing(spark, packing.packed(docs(spark, rows).withColumns({"piece": F.lit(1), "length": F.lit("x"), "_group": F.lit(0)}), BYTE).collect(), rows)
    assert packing.packed(docs(spark, []), BYTE).collect() == []
    assert len(packing.packed(docs(spark, [(None, "a"), (None, "a"), (7, "b"), (7, "b")]), BYTE).collect()) == 4


def test_large_ids_beside_nulls_and_hot_ids(spark):
    big = 2**53
    rows = [(big + 1, "a"), (None, "b"), (big + 3, "c")] + [(None, "same words")] * 300 + [(7, "same words")] * 300
    out = packing.pack(packing.pieces(docs(spark, rows), BYTE), len(rows), stream=100).collect()
    assert {r.doc_id for r in out} == {big + 1, None, big + 3, 7} and len(out) == len(rows)
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert len({s >> 32 for s in by_seq}) > 1  # equal rows are dealt to several streams


def test_very_long_texts_and_slices(spark, monkeypatch):
    long = "Some words, and numbers 12345 in lines.\n" * 60_000  # 2.4 million characters
    rows = docs(spark, [(1, long), (2, "short"), (2, "short"), (3, None)])
    lib, out = library(WORD), bpe.decode(bpe.encode(rows, WORD), WORD).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 4 and by[1].ids == lib.encode(long, add_special_tokens=False).ids and by[3].ids == []
    assert by[1].decoded == lib.decode(by[1].ids, skip_special_tokens=False)
    found = token_counts.count(rows, BYTE).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    assert {r.doc_id: r.n for r in found}[1] == len(library(BYTE).encode(long, add_special_tokens=False).ids)
    batch = rows.toArrow().to_batches()[0]
    pieces = list(common.slices([batch], rows=3, most=1000))
    assert [p.num_rows for p in pieces] and sum(p.num_rows for p in pieces) == batch.num_rows
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in pieces)

