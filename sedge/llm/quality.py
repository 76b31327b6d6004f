"""Quality: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes move over the UTF-8 bytes of the whole text by STRIDE, are
max-pooled over chunks of 2 * HALF bytes of which neighbours overlap by half, and rectified. HIDDEN
learned units combine the filters of a chunk, which may say that a chunk shows many patterns, or
too few. The largest value of every unit over the chunks feeds one logistic unit, which gives the
probability. All is trained together by Adam with gradients through the maxima.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm import common

WIDTH, STRIDE, FILTERS, HIDDEN, HALF = 6, 1, 48, 16, 128
SEGMENT = 1 << 16
STEPS, BATCH, RATE, SEED = 800, 24, 0.01, 7
FIT_PER_CLASS = 1500
THRESHOLD = 0.5


def symbols(text: str) -> np.ndarray:
    """Byte values; zero bytes pad to a whole block and to the width of a filter behind it."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(HALF, -(-len(raw) // HALF) * HALF) + WIDTH
    return np.frombuffer(raw.ljust(n, b"\0"), dtype=np.uint8)


def maxima(sym: np.ndarray, table: np.ndarray, places: bool = False):
    """The largest response of each filter in every block of HALF bytes (a row a block), and
    with places where it was. table: WIDTH x 256 x FILTERS."""
    blocks = (len(sym) - WIDTH) // HALF
    out, where = [], []
    step = SEGMENT // HALF
    for first in range(0, blocks, step):
        m = min(step, blocks - first)
        part = sym[first * HALF : (first + m) * HALF + WIDTH]
        count = m * HALF // STRIDE
        z = table[0].take(part[0 : STRIDE * count : STRIDE], axis=0)
        for j in range(1, WIDTH):
            z += table[j].take(part[j : j + STRIDE * count : STRIDE], axis=0)
        z = z.reshape(m, HALF // STRIDE, -1)
        if places:
            at = z.argmax(axis=1)
            where.append((first + np.arange(m))[:, None] * HALF + at * STRIDE)
            out.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        else:
            out.append(z.max(axis=1))
    return np.concatenate(out), np.concatenate(where) if places else None


def pooled(blocks: np.ndarray) -> np.ndarray:
    """Chunk values from block values: neighbours in pairs, so chunks overlap by a block."""
    return np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


@dataclass
class Model:
    """table, bias: the filters; mix, lift: the units of a chunk; unit, shift: the logistic unit."""

    table: np.ndarray
    bias: np.ndarray
    mix: np.ndarray
    lift: np.ndarray
    unit: np.ndarray
    shift: np.ndarray

    def score(self, text: str | None) -> float:
        chunks = np.maximum(pooled(maxima(symbols(text or ""), self.table)[0]) + self.bias, 0)
        units = np.maximum(chunks @ self.mix + self.lift, 0)
        return sigmoid(float(self.shift[0] + units.max(axis=0) @ self.unit))


def gradients(p: Model, sym: np.ndarray, label: int) -> tuple[float, dict[str, np.ndarray]]:
    """The logarithmic loss of one text and its derivatives by all parameters."""
    blocks, at = maxima(sym, p.table, places=True)
    left = np.arange(max(1, len(blocks) - 1))
    right = np.minimum(left + 1, len(blocks) - 1)
    pick = np.where(blocks[left] >= blocks[right], left[:, None], right[:, None])
    act = np.maximum(np.take_along_axis(blocks, pick, axis=0) + p.bias, 0)
    units = np.maximum(act @ p.mix + p.lift, 0)
    top = units.argmax(axis=0)
    hi = units[top, np.arange(len(top))]
    prob = sigmoid(float(p.shift[0] + hi @ p.unit))
    err = prob - label
    d_units = np.zeros_like(units)
    d_units[top, np.arange(len(top))] = err * p.unit * (hi > 0)
    rows = np.unique(top)  # all other chunks have no part in the result
    act, d_units = act[rows], d_units[rows]
    d_act = (d_units @ p.mix.T) * (act > 0)
    g = {"shift": np.array([err]), "unit": err * hi, "mix": act.T @ d_units, "lift": d_units.sum(axis=0), "bias": d_act.sum(axis=0), "table": np.zeros_like(p.table)}
    places = np.take_along_axis(at, pick, axis=0)[rows]
    k = np.broadcast_to(np.arange(p.table.shape[2]), places.shape)
    for j in range(WIDTH):
        np.add.at(g["table"][j], (sym[places + j], k), d_act)
    return -float(np.log(max(prob if label else 1 - prob, 1e-300))), g


def started(seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    return Model(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.full(FILTERS, 0.1), rng.normal(0, 0.3, (FILTERS, HIDDEN)), np.full(HIDDEN, 0.1), rng.normal(0, 0.3, HIDDEN), np.zeros(1))


def fit(texts: list[str], y: list[int], steps: int = STEPS) -> Model:
    """Deterministic. Without rows of both classes every score is 0.5. Batches hold as many
    rows of either class."""
    p, rng = started(), np.random.default_rng(SEED + 1)
    by = [[i for i, v in enumerate(y) if v == c] for c in (0, 1)]
    if not by[0] or not by[1]:
        p.unit[:] = 0
        return p
    names = ("table", "bias", "mix", "lift", "unit", "shift")
    m, v = ({k: np.zeros_like(getattr(p, k)) for k in names} for _ in range(2))
    syms: dict[int, np.ndarray] = {}
    for t in range(1, steps + 1):
        g = {k: np.zeros_like(getattr(p, k)) for k in names}
        for c in (0, 1):
            for i in rng.choice(by[c], BATCH // 2):
                if i not in syms:
                    syms[i] = symbols(texts[i])
                for k, d in gradients(p, syms[i], c)[1].items():
                    g[k] += d / BATCH
        g["unit"] += 1e-3 * p.unit
        g["mix"] += 1e-4 * p.mix
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            a = getattr(p, k)
            a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return p


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: good likelier) and `predicted` (1 from threshold on).

    Each text is scored whole and by itself, so rows that repeat have equal scores; a null text counts
    as empty. Columns of docs that have these
    two names are replaced, all others pass through. An empty table gives an empty table.
    """
    kept = common.without(docs, "score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            s = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample, see common.fit_sample: ids that are labelled both ways, held-out ones
    and texts of over FIT_MAX_CHARS code points take no part in it."""
    return fit(*common.fit_sample(docs, labels, "quality", FIT_PER_CLASS))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
