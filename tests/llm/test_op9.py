import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import op9_topk as topk


def brute(rows, is_query, k=10):
    ok = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in ok if i is not None and is_query(i)}:
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        scores = sorted((-clip(sum(a * b for a, b in zip(q, v, strict=True))), j is None, j or 0) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("wave", [4096, 5])
def test_equals_brute_force(spark, wave):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(24)]
    rows = [(i, [b + rng.gauss(0, 0.3) * (i % 5) for b in base]) for i in range(400)]  # many ties: copies of base
    rows += [(500, None), (510, []), (520, [None] * 24), (530, [float("nan")] * 24), (540, [float("inf")] + base[1:]), (None, base), (550, [1.0, 2.0]), (551, [3.0, -1.0]), (17, base), (20, [-b for b in base]), (20, base), (560, [1e307, -3e300, 5.5]), (561, [-1e307, 1.0, 2.0]), (570, [1e200, 1.0, 0.5]), (571, [1.0, 2.0, -3.25]), (None, [2.0, 1.0, 1.0])]
    data = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(5)
    got = topk.top_k(data, F.col("vec_id") % 10 == 0, wave=wave).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, lambda i: i % 10 == 0)
    assert topk.top_k(data.filter("false"), F.col("vec_id") % 10 == 0).collect() == []


def test_large_components_stay_exact():
    q = np.array([[2.0**40, 3.0], [-(2.0**40), 1.0]])
    assert topk.products(q, q).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]
    q = np.array([[2.0**30, 3.0]])
    assert topk.products(q, q).tolist() == [[2**60 + 9]]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = np.floor(rng.normal(0, 500, (40, 33))), np.floor(rng.normal(100, 500, (60, 33)))
    last = None
    for s in (1, 2, 4, 8, 16):
        bound = topk.statistics(q, s) @ topk.statistics(x, s).T
        assert (bound + 1e-6 >= q @ x.T).all()
        assert last is None or bound.mean() <= last
        last = bound.mean()
