"""Quality rules: a hashed n-gram logistic regression with calibrated probabilities.

Features are word 1- and 2-grams (lower-cased) and character 3-, 4- and 5-grams (as written), hashed into ``2**BITS`` weights; each family counts by its mean, so a text's length
doesn't matter and whole texts of any length are scored. The regression is trained on labelled quality rows, a Platt sigmoid is fitted on a part of them held out (a quarter, by the lowest hash of a text's n-grams, so that copies fall on
one side), and every document is scored in Arrow batches against fixed probabilities: ``KEEP`` decides, ``TIERS`` grade.

Nulls: a null text is the empty text; a text without any feature gets the calibrated probability of the bias alone. Rows of labels with a null doc_id or quality aren't trained on.
Without both classes among the labels, every document gets the share of good rows (1.0 where there are no labels at all). Repeated rows of a doc_id and text are trained on once and scored one by one; of contradicting labels the better
counts. Ties at a threshold are kept. An empty table gives no rows. Only doc_id and text (doc_id and quality of labels) are read, so other columns may have any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectext
from plumbline.llm.support import normal_text

BITS, KEEP, MAX_ROWS = 18, 0.5, 4000
#: Least probability of each grade, lowest first.
TIERS = (("poor", 0.0), ("fair", KEEP), ("good", 0.9))
CHARS = (3, 4, 5)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family the weights' places for all texts one after another, and where each text's begin with the end appended."""
    shift = np.uint64(64 - BITS)
    w = vectext.words(texts)
    for n in (1, 2):
        grams, first = vectext.ngram_hashes(w, n)
        yield ((grams * np.uint64(2 * n + 1)) >> shift).astype(np.int32), first
    data, offsets = vectext.text_bytes(texts)
    letters = np.frombuffer(data.tobytes().decode("utf8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets]
    code, end = letters, np.repeat(offsets[1:], np.diff(offsets))
    for n in range(2, max(CHARS) + 1):
        code = code[:-1] * np.uint64(0x100000001B3) + letters[n - 1 :] if len(code) else code
        if n in CHARS:
            inside = np.arange(len(code)) + n <= end[: len(code)]
            yield (vectext.mix(code[inside] + np.uint64(n)) >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, len(code))]


def raw_scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The regression's score of each text without bias: the sum over the families of the mean weight."""
    total = np.zeros(len(texts))
    for places, first in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(weights[places], dtype=np.float64)])
        total += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrating sigmoid, by Newton's method on Platt's smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    at = np.array([1.0, 0.0])

    def loss(x: np.ndarray) -> float:
        z = x[0] * scores + x[1]
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * (x[0] - 1) ** 2)

    for _ in range(100):
        p = _sigmoid(at[0] * scores + at[1])
        g = np.array([((p - t) * scores).sum() + 1e-3 * (at[0] - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * scores * scores).sum() + 1e-3, (v * scores).sum()], [(v * scores).sum(), v.sum()]])
        step, now = np.linalg.solve(h, g), loss(at)
        while np.abs(step).max() > 1e-9 and loss(at - step) > now:  # a whole step may overshoot
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(texts: list[str], y: np.ndarray, held: np.ndarray, steps: int = 80, l2: float = 1e-5) -> dict:
    """Weights, bias, calibration and held-out figures; ``held`` marks the rows that only calibrate."""
    index, value, row = [], [], []
    for k, text in enumerate(texts):
        for places, _ in features(pa.array([text])):
            if len(places):
                at, count = np.unique(places, return_counts=True)
                index.append(at), value.append((count / len(places)).astype(np.float32)), row.append(np.full(len(at), k, np.int32))
    index, value, row = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((index, np.int32), (value, np.float32), (row, np.int32)))
    fit = ~held[row] if len(row) else np.zeros(0, bool)
    i, v, r, n = index[fit], value[fit], row[fit], len(texts)
    w, bias, s, m = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), max(1, int((~held).sum()))
    # each class weighs the same, as clean rows are many
    each = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, (y[~held] > 0).sum()), 0.5 / max(1, (y[~held] <= 0).sum()))) * m
    s_bias = 1e-8
    for _ in range(steps):  # AdaGrad on the whole batch
        error = (_sigmoid(np.bincount(r, weights=w[i] * v, minlength=n) + bias) - y) * each / m
        g = np.bincount(i, weights=v * error[r], minlength=1 << BITS) + l2 * w
        s, s_bias = s + g * g, s_bias + error.sum() ** 2
        w, bias = w - 2.0 * g / np.sqrt(s), bias - 0.5 * error.sum() / np.sqrt(s_bias)
    scores = np.bincount(row, weights=w[index] * value, minlength=n) + bias
    a, b = _platt(scores[held], y[held]) if held.any() and 0 < y[held].sum() < held.sum() else (1.0, 0.0)
    p = _sigmoid(a * scores + b)
    accuracy = float(((p >= 0.5) == (y > 0))[held].mean()) if held.any() else None
    return {"weights": w.astype(np.float32), "bias": bias, "a": a, "b": b, "held_out": int(held.sum()), "accuracy": accuracy, "brier": float(((p - y) ** 2)[held].mean()) if held.any() else None}


def held_out(texts: list[str], y: np.ndarray) -> np.ndarray:
    """A quarter of the rows, by the lowest hash of a text's 3-grams of words; every fourth row where that leaves a class out on either side."""
    grams = [vectext.ngram_hashes(vectext.words(pa.array([t])), 3)[0] for t in texts]
    held = np.array([len(g) > 0 and int(g.min()) % 4 == 3 for g in grams])
    return held if len({*y[held]}) == len({*y[~held]}) == 2 else np.arange(len(y)) % 4 == 3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """The model, trained in one task on at most ``max_rows`` labelled rows (those of the lowest hash of doc_id); a quarter of them calibrates."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", normal_text().alias("text")).join(F.broadcast(sample), "doc_id")  # at most max_rows ids

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"])
        y = (pdf["quality"].to_numpy() > 0).astype(float)
        if 0 < y.sum() < len(y):
            model = train(pdf["text"].tolist(), y, held_out(pdf["text"].tolist(), y))
        else:
            model = {"weights": np.zeros(1 << BITS, np.float32), "bias": 0.0, "a": 0.0, "b": float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), "held_out": 0, "accuracy": None, "brier": None}
        weights = model.pop("weights")
        return pd.DataFrame({"weights": [weights.tobytes()], "rest": [json.dumps(model)]})

    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "weights binary, rest string").collect()
    if not found:
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": 0.0, "a": 0.0, "b": 50.0, "held_out": 0, "accuracy": None, "brier": None}
    return {"weights": np.frombuffer(found[0][0], np.float32)} | json.loads(found[0][1])


def score_quality(docs: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """(doc_id, quality, keep, tier) for each row of docs: the calibrated probability that it is good, whether that reaches ``keep``, and its grade."""
    names, least = pa.array([n for n, _ in TIERS]), np.array([x for _, x in TIERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.chunks(batch):
                p = _sigmoid(model["a"] * (raw_scores(part.column("text"), model["weights"]) + model["bias"]) + model["b"])
                tier = names.take(pa.array(np.searchsorted(least, p, side="right") - 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= keep), tier], names=["doc_id", "quality", "keep", "tier"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_text().alias("text")).mapInArrow(run, "doc_id bigint, quality double, keep boolean, tier string")
