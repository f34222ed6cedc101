"""Ranks and range sums by carried offsets, against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from treewarden.analytics import statistics as st
from treewarden.analytics.running import running_sums


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([1, 5, None])) for i in range(500)]
    rng.shuffle(rows)
    got = {(g, i): s for g, i, _, s in running_sums(spark.createDataFrame(rows, "g string, i int, v long").repartition(7), ["g"], ["i"], "v", "s").collect()}
    for group in ("a", "b", None):
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == group) if group else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total += v or 0
            assert got[(group, i)] == total


def test_ranks_of_one_group(spark):
    """One group of different values is dealt over all ranges; ties are averaged."""
    rng = random.Random(2)
    values = [float(rng.randrange(300)) for _ in range(1000)] + [1000.5 + i for i in range(3000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = sorted((r["v"], r["r_v"]) for r in st.ranks(df, ["v"], ["g"]).collect())
    inorder = sorted(values)
    assert got == [(v, inorder.index(v) + (inorder.count(v) + 1) / 2) for v in inorder]
    with_parts = df.repartitionByRange(4, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in with_parts) < 2000


def test_churn_by_both_ends(spark):
    """Against all pairs, with ties on both ends, unknown files, no time and many changes in each other's days; no join makes pairs."""
    rng = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    at = lambda: day + datetime.timedelta(days=rng.randrange(60), seconds=rng.choice([0, 0, 1]))
    commits = [(i, rng.choice("abc"), at()) for i in range(200)] + [(900, "z", day), (901, "a", None)]
    changes = [(rng.choice("ab"), at(), rng.choice([1, 2, None])) for _ in range(800)] + [("a", None, 5)]
    got = st.churn(spark.createDataFrame(commits, "key long, file string, at timestamp"), spark.createDataFrame(changes, "file string, changed_at timestamp, lines long"))
    want = [(k, f, sum(n or 0 for g, u, n in changes if g == f and t and u and t <= u <= t + datetime.timedelta(days=14))) for k, f, t in commits]
    assert sorted(map(tuple, got.collect())) == sorted(want)
