"""Hard negatives against brute force over all pairs, and the certainty of the intervals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("hopgraph.llm.hard_negatives")

from hopgraph.llm import hard_negatives as H  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, slice string, score string"


def brute(rows, is_anchor, positives=5, negatives=5, least=80, most=100):
    known = set()
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            known.add((i, label, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, label, v in known:
        if not is_anchor(i):
            continue
        scored = [(-dot(v, w), j, other) for j, other, w in known if j != i]
        for goal, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            found = sorted(r for r in scored if r[2] != label and least * -goal <= 100 * -r[0] <= most * -goal)[:negatives]
            out += [(i, p, k, j, -goal, -s) for k, (s, j, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame([(i, x, label, "s", "t") for i, x, label in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, anchors, **more).collect()))


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_intervals_hold(dim):
    rng = np.random.default_rng(dim)
    v = np.concatenate([rng.integers(-300, 300, (200, dim)), np.zeros((1, dim), int), rng.integers(0, 2, (20, dim)), rng.integers(-5, 9000, (20, dim))]).astype(np.int32)
    low, high = H.intervals(v[:60], *H.encoded(v))
    exact = v[:60].astype(np.int64) @ v.T.astype(np.int64)
    assert (low <= exact).all() and (exact <= high).all()
    assert (H.scores(v[:60], v, *np.divmod(np.arange(60 * len(v)), len(v))) == exact.ravel()).all()


def test_intervals_rule_pairs_out():
    """On vectors that lie in groups most far pairs need no score."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 64))
    v = np.floor(256 * np.concatenate([c + 0.2 * rng.normal(size=(50, 64)) for c in centres])).astype(np.int32)
    low, high = H.intervals(v[:50], *H.encoded(v))
    best = H.Best(50, 5)
    a, r = H.guesses(np.ones((50, 500), bool), low + high, 5)
    best.add(a, H.scores(v[:50], v, a, r), r)
    assert (high >= best.bar[:, None]).mean() < 0.35


def test_scores_of_large_components():
    v = np.array([[1 << 26, 3], [(1 << 26) + 1, -5]], np.int32)
    assert H.scores(v, v, np.array([0, 1]), np.array([1, 1])).tolist() == [(1 << 26) * ((1 << 26) + 1) - 15, ((1 << 26) + 1) ** 2 + 25]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(300)]
    # A large group of one vector, ties, repeated rows, ids that repeat with other vectors, odd and short vectors.
    rows += [(1000 + k, [0.5] * 8, k % 2) for k in range(150)] + rows[:20] + [(5, [0.25] * 8, 1), (10, [1.0] * 8, 2)]
    rows += [(2000, None, 1), (2010, [1.0] * 8, None), (None, [1.0] * 8, 1), (2020, [1.0, None] + [0.0] * 6, 1), (2030, [float("nan")] * 8, 1), (2040, [float("inf")] * 8, 1)]
    rows += [(2050, [], 1), (2060, [3.0], 2), (2070, [-1.0] * 8, 0), (2080, [0.0] * 8, 9)]
    expected = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == expected and len(expected) > 500
    monkeypatch.setattr(H, "ROWS", 32)
    monkeypatch.setattr(H, "ANCHORS", 4)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == expected
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, positives=2, negatives=3, least=50, most=120) == brute(rows, lambda i: i % 10 == 0, 2, 3, 50, 120)


def test_small_tables(spark):
    assert mined(spark, [], F.lit(True)) == []
    assert mined(spark, [(1, [1.0], 1)], F.lit(True)) == []
    assert mined(spark, [(1, [], 1), (2, [], 1), (3, [], 2)], F.col("vec_id") == 1) == [(1, 2, 1, 3, 0, 0)]
    assert mined(spark, [(1, [1e30], 1), (2, [1.0], 1), (3, [1.0], 2), (4, [1.0], 1)], F.col("vec_id") == 2) == [(2, 4, 1, 3, 65536, 65536)]
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)], F.col("vec_id") == 7) == []
