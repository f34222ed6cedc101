"""Intervals by the bootstrap against plain loops over replicates, and against a resampling of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treewarden.analytics import statistics as st


def rho(a, b):
    def ranks(v):
        return [sum(u < t for u in v) + (sum(u == t for u in v) + 1) / 2 for t in v]

    a, b = ranks(a), ranks(b)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    under = (sum((t - ma) ** 2 for t in a) * sum((t - mb) ** 2 for t in b)) ** 0.5
    return sum((s - ma) * (t - mb) for s, t in zip(a, b)) / under if under else 0.0


def partial(x, y, *controls):
    if not controls:
        return rho(x, y)
    *rest, z = controls
    xy, xz, yz = partial(x, y, *rest), partial(x, z, *rest), partial(y, z, *rest)
    return (xy - xz * yz) / max(1e-12, (1 - xz * xz) * (1 - yz * yz)) ** 0.5


@pytest.mark.parametrize("controls", [(), ("z",), ("z", "w")])
@pytest.mark.parametrize("most", [10000, 3])
def test_replicates(spark, controls, most):
    rng = random.Random(5)
    rows = [(float(a), float(a // 2 + rng.randrange(4)), float(rng.randrange(9)), rng.random()) for a in (rng.choice([0, 0, 0, 1, 2, 3, 5, 8]) for _ in range(60))] + [(0.0, 1.0, 2.0, 0.5)] * 5
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    names = ["x", "y", *controls]
    tuples = df.groupBy(*names).count().withColumn("k", F.xxhash64(F.lit(42), *names)).collect()
    w = st.poisson_weights(np.array([t["k"] for t in tuples]), np.array([t["count"] for t in tuples]), 40, 42)
    rhos = []
    for d in range(40):
        taken = [t for i, t in enumerate(tuples) for _ in range(w[i, d])]
        rhos.append(partial(*([t[n] for t in taken] for n in names)))
    rhos.sort()
    got = st.bootstrap(df, "x", "y", controls, draws=40, most=most).first()
    assert (got["low"], got["high"]) == pytest.approx((rhos[1], rhos[39]), abs=1e-9)


def test_equal_rows_are_drawn_one_by_one(spark):
    """As blocks, ten equal rows at a time, the interval would be far wider."""
    rows = [(float(a), float(b)) for a, b in [(0, 1), (1, 0), (2, 3), (3, 2), (4, 1), (5, 4)] for _ in range(10)]
    rng = random.Random(42)
    rhos = sorted(rho(*zip(*rng.choices(rows, k=len(rows)))) for _ in range(1000))
    got = st.bootstrap(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (got["low"], got["high"]) == pytest.approx((rhos[25], rhos[975]), abs=0.05)


def test_weights_have_no_bound():
    w = st.poisson_weights(np.arange(2000), np.ones(2000, dtype=int), 1000, 42)
    share = [(w == k).mean() for k in range(4)]
    assert share == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=0.002) and w.max() > 5


def test_ranks_are_carried_as_what_is_unexpected():
    """As ranks beyond 65,535 they took four bytes each."""
    rng = np.random.default_rng(5)
    far = np.array([[0, -1, 1, 127, -128], [128, -129, 300, -32768, 32767], [40000, 0, 0, 0, -1], [2**40, 0, 0, 0, -(2**40)]])
    assert (st._unpacked(st._packed(far), 5) == far).all()
    usual = np.rint(rng.normal(0, 100, (50, 1000))).astype(np.int64)
    packed = st._packed(usual)
    assert (st._unpacked(packed, 1000) == usual).all() and sum(map(len, packed)) < 1.4 * usual.size


def test_tasks_know_a_bounded_number_of_weights(spark, monkeypatch):
    """Every task once got the weights before and in all buckets, 8 bytes a bucket and replicate of each twice."""
    from pyspark import cloudpickle
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    monkeypatch.setattr(st, "SPANS", 16, raising=False)
    sent = []
    for kind in (PandasGroupedOpsMixin, PandasCogroupedOps):
        monkeypatch.setattr(kind, "applyInPandas", lambda self, f, schema, go=kind.applyInPandas: sent.append(len(cloudpickle.dumps(f))) or go(self, f, schema))
    rng = random.Random(3)
    rows = [(float(rng.randrange(900)), float(rng.randrange(900))) for _ in range(1500)] + [(7.0, float(a)) for a in range(40)] + [(float("inf"), 1.0)] * 2
    df = spark.createDataFrame(rows, "x double, y double")
    few = st.bootstrap(df, "x", "y", draws=200, most=5).first()
    assert max(sent) < 200_000
    assert tuple(few) == pytest.approx(tuple(st.bootstrap(df, "x", "y", draws=200).first()), abs=1e-9)


@pytest.mark.parametrize("most", [1000, 3, 1])
def test_ranks_a_few_rows_at_a_time(most):
    """Ties that are longer than what is taken at a time keep one rank, infinite ones too."""
    v = np.array([-np.inf, -np.inf, 1, 2, 2, 2, 2, 2, 3, 3, 4, np.inf, np.inf])
    w = np.random.default_rng(1).integers(0, 4, (len(v), 6))
    below = np.arange(6)
    got = np.concatenate([r for _, _, r, _ in st._ranked(v, lambda a, b: w[a:b], below, None, most)])
    want = [2 * (below + w[v < x].sum(axis=0)) + w[v == x].sum(axis=0) + 1 for x in v]
    assert (got == np.array(want)).all()
