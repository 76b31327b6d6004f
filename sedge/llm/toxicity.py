"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Lower-cased texts are cut into character 4-, 5- and 6-grams, hashed to 2^20 buckets. A bucket's
value x in a text is 1 - exp(-RATE * its share of the text's characters): near 1 if it is frequent,
near 0 if a long text holds it by chance. The fit takes r = log((p + a) / |p|) - log((q + a) / |q|)
from the sums p and q of x over either class, keeps the KEEP buckets with the strongest evidence and
fits a logistic regression with an L2 penalty over x * r. Scoring is one vectorised pass over each
whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm import common

BITS = 20
ORDERS = (4, 5, 6)
KEEP = 5000
RATE = 300
ALPHA = 0.5
PENALTY = 1.0
SEGMENT = 1 << 20
THRESHOLD = 0.7
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


def buckets(text: str):
    """Yields arrays of bucket numbers of every n-gram of the lower-cased, padded text."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for start in range(0, max(1, len(chars) - 1), SEGMENT):
        part = chars[start : start + SEGMENT + max(ORDERS) - 1]
        h, n = part * _MULT[0], len(part)
        for k in range(1, max(ORDERS)):
            if n <= k:
                break
            h = h[: n - k] + part[k:] * _MULT[k]
            if k + 1 in ORDERS:
                x = h ^ (h >> np.uint32(15))
                x = (x + np.uint32(k)) * np.uint32(0x2C1B3C6D)
                yield (x >> np.uint32(32 - BITS))[:SEGMENT]


def values(counts: np.ndarray, text: str) -> np.ndarray:
    return 1 - np.exp(counts * (-RATE / (len(text) + 2)))


@dataclass
class Model:
    """bucket[i] has the weight weight[i] (the coefficient times r); bias is the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        slot = np.zeros(1 << BITS, dtype=np.uint16)
        slot[self.bucket] = np.arange(1, len(self.bucket) + 1)

        def score(text: str | None) -> float:
            counts = np.zeros(len(self.bucket) + 1)
            for b in buckets(text or ""):
                counts += np.bincount(slot[b], minlength=len(counts))
            z = self.bias + float(self.weight @ values(counts[1:], text or ""))
            return float(1.0 / (1.0 + np.exp(-max(-60.0, min(60.0, z)))))

        return score


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their values."""
    found, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *buckets(text)]), return_counts=True)
    return found, values(counts, text)


def fit(texts: list[str], y: list[int]) -> Model:
    """Deterministic. Without rows of both classes every score is 0.5."""
    target = np.asarray(y, dtype=float)
    n1, n0 = target.sum(), (1 - target).sum()
    if not n1 or not n0:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    sums, held = np.zeros((2, 1 << BITS)), np.zeros(1 << BITS, dtype=np.int32)
    for text, label in zip(texts, y, strict=True):  # features are made twice rather than all held
        found, x = features(text)
        sums[label, found] += x
        held[found] += 1
    r = np.log((sums[1] + ALPHA) / (n1 + 2 * ALPHA)) - np.log((sums[0] + ALPHA) / (n0 + 2 * ALPHA))
    strength = np.abs(r) * np.abs(sums[1] / n1 - sums[0] / n0)
    strength[held < 2] = 0
    kept = np.sort(np.argsort(-strength, kind="stable")[:KEEP])
    kept = kept[strength[kept] > 0]
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[kept] = np.arange(len(kept))
    cols, parts = [], []
    for text in texts:
        found, x = features(text)
        c = column[found]
        cols.append(c[c >= 0])
        parts.append(x[c >= 0].astype(np.float32))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in cols])
    col, value = np.concatenate(cols), np.concatenate(parts)
    del cols, parts
    scale = r[kept]
    share = np.where(target == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(kept)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, 301):
        z = np.bincount(row, weights=(w * scale)[col] * value, minlength=len(texts)) + b
        err = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target)
        gw = np.bincount(col, weights=err[row] * value, minlength=len(kept)) * scale + PENALTY / len(texts) * w
        gb = err.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        f1, f2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.01 * (mw / f1) / (np.sqrt(vw / f2) + 1e-8)
        b = b - 0.01 * (mb / f1) / (np.sqrt(vb / f2) + 1e-8)
    return Model(kept, w * scale, float(b))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: toxic likelier) and `predicted` (1 from threshold on).

    Each text is scored whole and by itself, so rows that repeat have equal scores; a null text counts
    as empty. Columns of docs that have these
    two names are replaced, all others pass through. An empty table gives an empty table.
    """
    kept = common.without(docs, "score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        of = model.scorer()
        for batch in batches:
            s = [of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample, see common.fit_sample: ids that are labelled both ways, held-out ones
    and texts of over FIT_MAX_CHARS code points take no part in it."""
    return fit(*common.fit_sample(docs, labels, "toxic"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
