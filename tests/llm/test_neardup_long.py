import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from sedge.llm import neardup
from tests.llm.tables import docs, shingle_set

PLAIN = 2_000_000


def long_text(n_words, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(20_000)]
    return " ".join(r.choices(vocabulary, k=n_words))


def test_memory_of_a_long_text():
    """Bytes, words and the set take a few times the text's bytes; a text as one array of 8 bytes each took over 20 times."""
    text = long_text(PLAIN // 7)
    neardup.registers(neardup.shingles(long_text(PLAIN // 7, 4), 5))  # what is made once
    tracemalloc.start()
    try:
        found = neardup.shingles(text, 5)
        regs = neardup.registers(found)
        most = tracemalloc.get_traced_memory()[1]
        assert most < 10 * len(text)
        tracemalloc.reset_peak()
        name = neardup.name_of(found)
        same = neardup.shared_size(found, found)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(text)
    finally:
        tracemalloc.stop()
    assert len(found) == len(shingle_set(text, 5)) == same and len(regs) == neardup.REGISTERS and len(name) == 2


@pytest.mark.parametrize("segment", [1, 2, 7, 64])
def test_segments_change_nothing(monkeypatch, segment):
    r = random.Random(segment)
    texts = ["".join(r.choices("abAé \t\n 日", k=r.randrange(90))) for _ in range(300)]
    texts += [None, "", " ", "x" * 200, "x" * 64 + " y", " " * 70 + "y", "Ab " * 40]

    def results():
        neardup._powers.cache_clear()
        sets = [neardup.shingles(t, 3) for t in texts]
        shared = [neardup.shared_size(a, b) for a, b in zip(sets, sets[1:])]
        return sets, [(neardup.registers(s).tolist(), neardup.name_of(s)) for s in sets if len(s)], shared

    whole = results()
    assert [len(s) for s in whole[0]] == [len(shingle_set(t, 3)) for t in texts]
    assert whole[2] == [len(shingle_set(a, 3) & shingle_set(b, 3)) for a, b in zip(texts, texts[1:])]
    monkeypatch.setattr(neardup, "SEGMENT", segment)
    try:
        cut = results()
    finally:
        neardup._powers.cache_clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole[0], cut[0]))
    assert whole[1:] == cut[1:]


def test_pipeline_stage_on_long_texts(spark):
    """Texts of many segments, one of them a single word, are linked as short ones are."""
    text = long_text(200_000)
    rows = [(1, text), (2, text.upper() + " more"), (3, long_text(200_000, 5)), (4, "y" * 1_000_000), (5, "Y" * 1_000_000), (6, "y" * 999_999)]
    assert all(len(t) > 3 * neardup.SEGMENT for _, t in rows)
    near = corpus_pipeline.keep_one_of_near(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in near.collect()) == [1, 3, 4, 6]
