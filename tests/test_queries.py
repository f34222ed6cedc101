import datetime
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from treewarden.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)

    def rows(df):
        return sorted(tuple("" if pd.isna(v) else str(round(float(v), 5)) if isinstance(v, (numbers.Number, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(mine) == rows(theirs)


def test_whole_tables(spark):
    """The queries over all rows against plain loops: every order has a row, every change and every line counts."""
    o, li = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    first, changes, hits = {}, {}, {}
    for r in o:
        first[r["o_custkey"]] = min(first.get(r["o_custkey"], r["o_orderdate"]), r["o_orderdate"])
    for r in li:
        changes.setdefault(r["l_orderkey"] % 100, []).append((r["l_shipdate"], int(r["l_quantity"])))
        if r["l_discount"] > 0.07:
            hits.setdefault(r["l_partkey"], []).append(int(r["l_quantity"]))
    ages = {r["o_orderkey"]: (r["o_orderdate"] - first[r["o_custkey"]]).days for r in o}
    assert {r["o_orderkey"]: r["age_days"] for r in QUERIES["file_age_all"](spark, SF).collect()} == ages
    days = datetime.timedelta(days=14)
    churn = {r["o_orderkey"]: sum(n for at, n in changes.get(r["o_custkey"] % 100, []) if r["o_orderdate"] <= at <= r["o_orderdate"] + days) for r in o}
    assert {r["key"]: r["churn"] for r in QUERIES["churn_14d_all"](spark, SF).collect()} == churn
    bands = {}
    for r in li:
        if not r["l_discount"] > 0.07:
            n = bands.setdefault(f"f{r['l_partkey']}", [0, 0])
            n[0] += 1
            n[1] += any(abs(h - int(r["l_quantity"])) <= 3 for h in hits.get(r["l_partkey"], []))
    assert {r["file"]: [r["findings"], r["covered"]] for r in QUERIES["overlap_band_all"](spark, SF).collect()} == bands
    assert any(c < n for n, c in bands.values())
