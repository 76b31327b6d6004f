import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import common, quality, toxicity
from tests.conftest import SF
from tests.llm.tables import DOCS, docs, held


@pytest.mark.parametrize("op, label, least", [(toxicity.op1_toxicity, "toxic", 0.85), (quality.op5_quality, "quality", 0.95)])
def test_held_out_rows_rank_well(spark, op, label, least):
    out = op(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = out.toPandas()
    assert len(found) == common.table(spark, SF, "documents").count()
    assert found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(held)).all()
    both = found.merge(common.table(spark, SF, "labels").toPandas(), on="doc_id")
    both = both[both.held_out]
    good, bad = both[both[label] == 1].score.to_numpy(), both[both[label] == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() >= least


def test_toxic_rows_are_caught_and_others_left(spark):
    found = toxicity.op1_toxicity(spark, SF).join(common.table(spark, SF, "labels"), "doc_id").toPandas()
    assert found[found.toxic == 1].predicted.mean() > 0.85
    assert found[found.toxic == 0].predicted.mean() < 0.02


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    texts = ["good words here " * 5, "bad filth filth " * 5] * 6
    model = module.fit(texts, [0, 1] * 6)
    rows = docs(spark, [(1, None), (2, ""), (3, "x"), (None, "bad filth"), (3, "x"), (5, "word " * 40_000)]).withColumn("Score", F.lit("old"))
    out = module.score(rows, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert out[0].score == out[1].score and out[2].score == out[4].score
    assert {"doc_id", "text", "lang", "source", "n_chars", "score", "predicted"} == set(out[0].asDict())
    assert module.score(spark.createDataFrame([], DOCS), model).collect() == []


@pytest.mark.parametrize("module", [toxicity, quality])
def test_one_class_scores_one_half(module):
    model = module.fit(["a text"], [1])
    score = model.scorer()("some text") if module is toxicity else model.score("some text")
    assert score == pytest.approx(0.5)


def test_the_sample_leaves_out_what_is_held_out(spark):
    rows = docs(spark, [(i, f"text {i}") for i in range(60)] + [(None, "null id"), (7, "text 7 again")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, y = common.fit_sample(rows, labels, "toxic", per_class=10)
    assert len(texts) <= 20 and sorted(set(y)) == [0, 1]
    assert not {t for t in texts} & {f"text {i}" for i in range(60) if held(i)}


def test_repeats_and_long_texts_have_whole_scores():
    model = toxicity.fit(["fine words"] * 5 + ["vile slurs"] * 5, [0] * 5 + [1] * 5)
    score = model.scorer()
    assert score("vile slurs " * 3) > 0.5 > score("fine words " * 3)
    counts = np.concatenate(list(toxicity.buckets("ab" * toxicity.SEGMENT)))
    assert len(counts) == sum(2 * toxicity.SEGMENT + 2 - k + 1 for k in toxicity.ORDERS)


def test_conflicting_labels_take_no_part_in_any_order(spark):
    clash, same, twice = [i for i in range(60) if not held(i)][:3]
    rows = docs(spark, [(i, f"text {i}") for i in range(60)] + [(twice, "another text")])
    labels = [(i, i % 2) for i in range(60)] + [(clash, 1 - clash % 2), (same, same % 2)]
    got = [common.fit_sample(rows.repartition(n), spark.createDataFrame(labels[::step], "doc_id long, toxic int").repartition(n), "toxic") for n, step in ((1, 1), (7, -1), (3, 1))]
    assert got[0] == got[1] == got[2]
    texts = got[0][0]
    assert f"text {clash}" not in texts and texts.count(f"text {same}") == 1
    assert "another text" in texts and f"text {twice}" not in texts


def slow_toxicity(model, text):
    """The score from counts in a dictionary and hashes in Python's integers."""
    mask, mult = (1 << 32) - 1, [int(m) for m in toxicity._MULT]
    chars, counts = [ord(c) for c in f" {text.lower()} "], {}
    for n in toxicity.ORDERS:
        for i in range(len(chars) - n + 1):
            h = sum(c * m for c, m in zip(chars[i : i + n], mult)) & mask
            h = ((h ^ (h >> 15)) + n - 1) * 0x2C1B3C6D & mask
            counts[h >> (32 - toxicity.BITS)] = counts.get(h >> (32 - toxicity.BITS), 0) + 1
    z = model.bias
    for bucket, weight in zip(model.bucket.tolist(), model.weight.tolist()):
        z += weight * (1 - math.exp(-toxicity.RATE * counts.get(bucket, 0) / (len(text) + 2)))
    return 1 / (1 + math.exp(-z))


def slow_quality(p, text):
    """The score by loops over places, chunks and units."""
    raw = text.encode()
    blocks = max(1, -(-len(raw) // quality.HALF))
    raw = raw.ljust(blocks * quality.HALF + quality.WIDTH, b"\0")
    top = [-math.inf] * p.mix.shape[1]
    for chunk in range(max(1, blocks - 1)):
        act = []
        for f in range(p.table.shape[2]):
            places = range(chunk * quality.HALF, min(chunk + 2, blocks) * quality.HALF, quality.STRIDE)
            act.append(max(0.0, max(sum(float(p.table[j, raw[at + j], f]) for j in range(quality.WIDTH)) for at in places) + p.bias[f]))
        for h in range(len(top)):
            top[h] = max(top[h], 0.0, p.lift[h] + sum(a * p.mix[f, h] for f, a in enumerate(act)))
    return 1 / (1 + math.exp(-(p.shift[0] + sum(t * u for t, u in zip(top, p.unit)))))


TEXTS = ["", "x", "vile slurs and fine words, é à 日本 " * 20, "fine words " * 60, "Slurs!" * 70]


def test_toxicity_equals_a_slow_scorer():
    model = toxicity.fit(["fine words of a day"] * 5 + ["vile slurs of a day"] * 5, [0] * 5 + [1] * 5)
    for text in TEXTS:
        assert model.scorer()(text) == pytest.approx(slow_toxicity(model, text), abs=1e-9)


def test_quality_equals_a_slow_scorer(monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", 3 * quality.HALF)
    monkeypatch.setattr(quality, "FILTERS", 5)
    model = quality.started(3)
    for text in TEXTS:
        assert model.score(text) == pytest.approx(slow_quality(model, text), abs=1e-5)


@pytest.mark.parametrize("label", [0, 1])
def test_gradients_of_quality_are_the_numeric_ones(monkeypatch, label):
    monkeypatch.setattr(quality, "FILTERS", 4)
    p = quality.started(5)
    p.table = p.table.astype(float)
    sym = quality.symbols("some words, repeated words and others " * 12)
    loss, g = quality.gradients(p, sym, label)
    r = np.random.default_rng(1)
    for name, d in g.items():
        a, flat = getattr(p, name).reshape(-1), d.reshape(-1)
        picked = np.concatenate([np.argsort(-np.abs(flat))[:5], r.integers(0, len(a), 5)])
        for i in picked:
            old, step = a[i], 1e-6
            a[i] = old + step
            up = quality.gradients(p, sym, label)[0]
            a[i] = old - step
            down = quality.gradients(p, sym, label)[0]
            a[i] = old
            assert (up - down) / (2 * step) == pytest.approx(flat[i], abs=1e-6, rel=1e-4)


def test_the_fit_of_toxicity_is_near_its_optimum():
    r = np.random.default_rng(0)
    words = [f"w{i}x" for i in range(40)]
    texts = [" ".join(r.choice(words[10 * y : 10 * y + 30], 30)) for y in (0, 1) for _ in range(40)]
    y = [0] * 40 + [1] * 40
    model = toxicity.fit(texts, y)
    errors = np.array([model.scorer()(t) - v for t, v in zip(texts, y)])
    assert abs(errors.mean()) < 0.02  # the derivative by the intercept
    assert (np.abs(errors) < 0.5).mean() > 0.9
