"""The base by brute force, and the model as a distribution that beats it on held-out texts."""

import math
from collections import Counter

import numpy as np
import pytest
from llm_helpers import crc, frame, odd_rows, words

from wildtally.llm import language_model as L


@pytest.mark.parametrize("limits", [{}, {"CHUNK_TOKENS": 3000, "BUCKET_WORDS": 100}])
def test_base(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(L, name, value)
    rows = odd_rows() + [(None, "w1 w2 unseen"), (10, "w1 w2")]
    tokens = [(d, [*words(t, fold=True), None]) for d, t in rows]
    out = lambda d: d is not None and crc(d, 7) == 2
    counts = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((d, out(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens), key=repr)
    got = L.train_and_score(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == expected
    assert all(r.score < 0 for r in got)


def test_without_training_rows(spark):
    held = next(i for i in range(100) if crc(i, 7) == 2)
    row = L.train_and_score(frame(spark, [(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert L.train_and_score(frame(spark, [])).collect() == []


def test_probabilities_sum_to_one():
    model = L.Model([0, 1, 2, 9], [1, 20, 30, 10], 50, 10)
    model.weights = np.random.RandomState(1).normal(size=model.weights.shape).astype(np.float32)
    features = L._features(np.array([[0, 0, 5]]), np.arange(5, dtype=np.uint16))
    assert np.allclose(L._likely(model.bias, model.weights, features, slice(0, 5)).sum(axis=1), 1, atol=1e-5)
    # Masses hold count + 1 of each word of the class, so within a class the shares sum to 1 as well.
    assert np.isclose(np.exp(model.bias).sum(), 1)


def test_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)
    ones = lambda n: np.full(4, n, dtype=np.float32).tobytes()
    for tasks in (1, 3, 4, 29):
        rows = [(part, block, ones(part + block), ones(1)) for part in range(tasks) if part != 2 for block in range(2)]
        plan = L.summed(spark.createDataFrame(rows, L._SUM_DDL), tasks)
        got = {r.block: (np.frombuffer(r.slope, np.float32).tolist(), np.frombuffer(r.bend, np.float32).tolist()) for r in plan.collect()}
        parts = [p for p in range(tasks) if p != 2]
        assert got == {b: ([sum(parts) + b * len(parts)] * 4, [len(parts)] * 4) for b in range(2)}


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in L.train_and_score(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.05
