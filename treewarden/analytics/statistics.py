"""Overlap with another linter, sampling, label scores, churn, and rank correlations."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from .running import running_sums


def band_overlap(findings: DataFrame, hits: DataFrame, tolerance: int = 3) -> DataFrame:
    """findings (file, line) marked covered if a hit (path, row) lies within the tolerance: an equi-join on the file and on bands of lines, at most three for each finding."""
    width = 2 * tolerance + 1
    banded = findings.withColumn("_id", F.monotonically_increasing_id())
    probe = banded.select("_id", "file", "line", F.explode(F.array_distinct(F.array(F.floor((F.col("line") - tolerance) / width), F.floor((F.col("line") + tolerance) / width)))).alias("band"))
    stored = hits.select(F.col("path").alias("file"), "row", F.floor(F.col("row") / width).alias("band")).distinct()
    covered = probe.join(stored, ["file", "band"]).where(F.abs(F.col("row") - F.col("line")) <= tolerance).select("_id").distinct().withColumn("covered", F.lit(True))
    return banded.join(covered, "_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False))).drop("_id")


def quotas(groups: DataFrame, n: int, least: int = 3) -> DataFrame:
    """groups (name, available): at least min(3, available) each, the remainder of n in proportion to what is left, halves to even."""
    first = F.least(F.lit(least), F.col("available"))
    everything = Window.partitionBy(F.lit(1))  # a row a group
    g = groups.withColumn("first", first).withColumn("weight", F.col("available") - F.col("first"))
    g = g.withColumn("left", n - F.sum("first").over(everything)).withColumn("total", F.greatest(F.sum("weight").over(everything), F.lit(1)))
    extra = F.when(F.col("left") > 0, F.least(F.bround(F.col("left") * F.col("weight") / F.col("total")).cast("long"), F.col("weight"))).otherwise(0)
    return g.select("name", "available", (F.col("first") + F.greatest(extra, F.lit(0))).cast("long").alias("quota"))


def _drawn(seed: int, key: str) -> Column:
    """The order of a sample: digests of the seed and the key, the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(rows: DataFrame, name: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A deterministic sample of ``rows`` by the quotas of its groups, by group and within it in the order of a seeded digest of the key. At most n rows of a group leave a task."""
    groups = rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("available"))
    order = Window.partitionBy(name).orderBy(_drawn(seed, key), key)
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return first.join(quotas(groups, n), first[name] == F.col("name")).where("_n <= quota").orderBy(name, "_n").select(rows.columns)


def sampled_commits(commits: DataFrame, n: int, until, days: int = 14, seed: int = 42) -> DataFrame:
    """``n`` of the commits (sha, at) that are at least ``days`` older than ``until``, oldest first."""
    old = commits.where(F.col("at") <= until - F.expr(f"INTERVAL '{days}' DAY"))
    return old.orderBy(_drawn(seed, "sha"), "sha").limit(n).orderBy("at", "sha")


def overlap_totals(marked: DataFrame) -> DataFrame:
    """Of band_overlap's rows: how many findings, how many covered and how many not, and the shares in per cent (zero without any)."""
    share = lambda c: F.coalesce(F.round(100 * F.try_divide(F.col(c), F.col("findings")), 1), F.lit(0.0)).alias(f"{c}_pct")
    return marked.agg(F.count("*").alias("findings"), F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("unique")).select("*", share("covered"), share("unique"))


def repo_ranges(rows: DataFrame) -> DataFrame:
    """rows (repo, sha, at, file): per repository the first and last time, and how many rows, commits and files."""
    return rows.groupBy("repo").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_rows"), F.countDistinct("sha").alias("commits"), F.countDistinct("file").alias("files"))


def touched(rows: DataFrame) -> DataFrame:
    """The observations with any churn, and the logarithm of one plus each count."""
    return rows.where("churn_14d > 0").withColumns({f"log_{c}": F.log1p(c) for c in ("loc", "warns_dup", "warns_em", "churn_14d")})


def label_scores(labels: DataFrame) -> DataFrame:
    """labels (repo, kind, label): counts in total, per repo and per kind; precision without unclear and boilerplate, actionable share of all, and what that share calls for: pass, threshold or redesign."""
    n = {x: F.count_if(F.col("label") == x) for x in ("tp", "fp", "boilerplate", "style", "unclear")}
    g = labels.where("label IS NOT NULL").groupingSets([[], ["repo"], ["kind"]], "repo", "kind").agg(*[v.alias(k) for k, v in n.items()], F.count("*").alias("labeled"))
    judged = F.col("labeled") - F.col("unclear") - F.col("boilerplate")
    return g.withColumn("precision", F.when(judged > 0, F.round(F.col("tp") / judged, 6))).withColumn("actionable", F.round(F.col("tp") / F.col("labeled"), 6)).withColumn("gate", F.when(F.col("tp") >= 0.4 * F.col("labeled"), "pass").when(F.col("tp") >= 0.2 * F.col("labeled"), "threshold").otherwise("redesign"))


def churn(commits: DataFrame, changes: DataFrame, days: int = 14) -> DataFrame:
    """commits (key, file, at) and changes (file, changed_at, lines): lines changed in [at, at + days], zero without any.

    Changes are summed up in order of file and time, and both ends of each commit's days are looked up there: what is changed up to the last moment less what is before the first. Rows are two a
    commit and one a change, however many changes lie in a commit's days.
    """
    time = lambda c: c.cast("timestamp").alias("t")
    none = F.lit(None).cast(commits.schema["key"].dataType).alias("key")
    first = commits.select("file", time(F.col("at")), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("lines"), "key")
    last = commits.select("file", time(F.col("at") + F.expr(f"INTERVAL '{days}' DAY")), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("lines"), "key")
    between = changes.select("file", time(F.col("changed_at")), F.lit(1).alias("kind"), F.col("lines").cast("long").alias("lines"), none)
    summed = running_sums(between.unionAll(first).unionAll(last).where("t IS NOT NULL"), ["file"], ["t", "kind"], "lines", "to")
    sums = summed.where("kind != 1").groupBy("key").agg(F.sum(F.when(F.col("kind") == 2, F.col("to")).otherwise(-F.col("to"))).alias("churn"))
    return commits.select("key", "file").join(sums, "key", "left").select("key", "file", F.coalesce("churn", F.lit(0)).cast("long").alias("churn"))


def warns_per_file(findings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Warnings of each file, duplicated blocks and masked errors counted; a file with other warnings only has zeros."""
    n = {"warns_dup": "dup.block", "warns_em": "risk.error-masking"}
    return findings.where("severity = 'warn'").groupBy(*keys, "file").agg(*[F.count_if(F.col("analyzer_id") == a).alias(c) for c, a in n.items()])


def warns_and_churn(warns: DataFrame, churned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every file of either side, zero where the other has none."""
    both = warns.join(churned, [*keys, "file"], "full_outer")
    return both.select(*keys, "file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("warns_dup", "warns_em", "churn")])


def file_age(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """rows (repo, file, at) with age_days: whole days since the file's first commit (repo, file, first), never below zero, null without one."""
    days = F.floor((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400_000_000)
    return rows.join(firsts, ["repo", "file"], "left").withColumn("age_days", F.when(F.col("first").isNotNull() & F.col("at").isNotNull(), F.greatest(days, F.lit(0)))).drop("first")


def ranks(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Adds r_<column>: ranks within the group, ties averaged.

    Values are counted, so equal ones are one row each; counts are summed up over ranges of values, of which a large group has many, and joined back by value.
    """
    for c in columns:
        counts = df.groupBy(*group, c).agg(F.count("*").alias("_n"))
        ranked = running_sums(counts, group, [c], "_n", "_to").withColumn(f"r_{c}", F.col("_to") - (F.col("_n") - 1) / 2).drop("_n", "_to")
        df = df.join(ranked, [*group, c])
    return df


def _corr(a: str, b: str) -> Column:
    c = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def _partial(xy: Column, xz: Column, yz: Column) -> Column:
    under = (1 - xz * xz) * (1 - yz * yz)
    return (xy - xz * yz) / F.sqrt(F.greatest(under, F.lit(1e-12)))


def _controlled(c, x, y, z=None, w=None) -> Column:
    """Rho of x and y by the correlations ``c`` of pairs, with up to two controls."""
    if z is None:
        return c(x, y)
    once = lambda a, b: _partial(c(a, b), c(a, z), c(b, z))
    return once(x, y) if w is None else _partial(once(x, y), once(x, w), once(y, w))


def spearman(df: DataFrame, x: str, y: str, group: list[str], controls: tuple[str, ...] = ()) -> DataFrame:
    """Spearman's rho per group, with up to two controls; zero where a side is constant."""
    names = [x, y, *controls]
    ranked = ranks(df, names, group)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    g = ranked.groupBy(*group).agg(F.count("*").alias("n"), *[_corr(f"r_{a}", f"r_{b}").alias(f"c_{a}_{b}") for a, b in pairs])
    c = lambda a, b: F.col(f"c_{a}_{b}" if (a, b) in pairs else f"c_{b}_{a}")
    return g.select(*group, "n", _controlled(c, *names).alias("rho"))


def fisher_mean(rhos: DataFrame, least: int = 30) -> DataFrame:
    """Weighted mean of rhos (n, rho) on Fisher's scale, with its interval."""
    z, w = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("rho")))), F.col("n") - 3
    g = rhos.where(F.col("n") >= least).agg(F.sum(z * w).alias("zw"), F.sum(w).alias("w"), F.count("*").alias("groups"))
    mean, se = F.col("zw") / F.col("w"), 1 / F.sqrt("w")
    return g.select("groups", F.tanh(mean).alias("rho"), F.tanh(mean - 1.96 * se).alias("low"), F.tanh(mean + 1.96 * se).alias("high"))


#: 2^53 times the distribution function of the Poisson law of mean 1, up to where it can't be told from 2^53.
_POISSON = np.array([int(2**53 * math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(18)], dtype=np.uint64)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def poisson_weights(keys: np.ndarray, counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each replicate takes the ``counts`` equal rows behind each key: sums of that many Poisson numbers of mean 1, the same wherever they are asked for."""
    lanes = _mixed(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    u = _mixed(keys.astype(np.int64).view(np.uint64)[:, None] ^ lanes[None, :]) >> np.uint64(11)
    w = np.zeros(u.shape, dtype=np.int64)
    for t in _POISSON[:6]:
        w += u >= t
    far = u >= _POISSON[5]
    w[far] = np.searchsorted(_POISSON, u[far], side="right")
    for i in np.flatnonzero(counts > 1):
        w[i] = np.random.Generator(np.random.Philox(key=(int(keys[i]) % 2**64) | (seed % 2**64) << 64)).poisson(counts[i], draws)
    return w


def _buckets(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Odd numbers for the values that are bounds, even ones for those between."""
    return np.searchsorted(bounds, v, "left") + np.searchsorted(bounds, v, "right")


def _packed(r: np.ndarray) -> list[bytes]:
    """Each row of whole numbers in the narrowest width that holds all of it. Of two bytes the upper ones, with the sign in the lowest bit mostly zeros, are compressed: a rank less the expected one takes little more than a byte."""
    out: list[bytes] = [b""] * len(r)
    least, most = r.min(axis=1), r.max(axis=1)
    left = np.ones(len(r), dtype=bool)
    for kind in ("i1", "i2", "i4", "i8"):
        fits = left & (least >= np.iinfo(kind).min) & (most <= np.iinfo(kind).max)
        for i, row in zip(np.flatnonzero(fits), r[fits].astype(kind)):
            if kind == "i2":
                z = ((row << 1) ^ (row >> 15)).view(np.uint16)
                out[i] = b"i2" + (z & 255).astype(np.uint8).tobytes() + zlib.compress((z >> 8).astype(np.uint8).tobytes(), 1)
            else:
                out[i] = kind.encode() + row.tobytes()
        left &= ~fits
    return out


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """What was packed, ``width`` numbers a row."""
    out = np.empty((len(rows), width), dtype=np.int64)
    for i, b in enumerate(rows):
        if b[:2] == b"i2":
            z = np.frombuffer(b, np.uint8, width, 2) | np.frombuffer(zlib.decompress(b[2 + width :]), np.uint8).astype(np.int32) << 8
            out[i] = (z >> 1) ^ -(z & 1)
        else:
            out[i] = np.frombuffer(b, b[:2].decode(), offset=2)
    return out


def _expected(knots: np.ndarray, span: int | np.ndarray, share: np.ndarray) -> np.ndarray:
    """Twice a row's rank as its span of buckets and its place there let expect: the weight before the span (``knots``, a row a span and one for the end), and of the span's weight the place's share, in whole numbers."""
    return 2 * knots[span] + (2 * (knots[span + 1] - knots[span]) * share[:, None] >> 20)


def _ranked(v: np.ndarray, take: Callable[[int, int], np.ndarray], below: np.ndarray, whole: np.ndarray | None, most: int = 1000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """Twice the ranks of one bucket's rows, whose values ``v`` are in order, ``most`` rows at a time: begin, end, ranks, and the weights where they were made for them. ``take`` makes the weights of rows from begin to end, ``below`` is the weight before the bucket, and ``whole`` that of a bucket of equal values."""
    if whole is not None:
        r = 2 * below + whole + 1
        for at in range(0, len(v), most):
            yield at, min(at + most, len(v)), np.broadcast_to(r, (min(most, len(v) - at), len(r))), None
        return
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.array([], dtype=int)
    ends = np.append(starts[1:], len(v))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))  # whole ties
        begin, end = int(starts[i]), int(ends[j - 1])
        if end - begin > most:
            own = sum(take(at, min(at + most, end)).sum(axis=0) for at in range(begin, end, most))
            yield from ((begin + a, begin + b, r, None) for a, b, r, _ in _ranked(v[begin:end], take, below, own, most))
            below = below + own
        else:
            w = take(begin, end)
            own = np.add.reduceat(w, starts[i:j] - begin, axis=0)
            to = below + np.cumsum(own, axis=0)
            yield begin, end, (2 * to - own + 1)[np.repeat(np.arange(j - i), ends[i:j] - starts[i:j])], w
            below = to[-1]
        i = j


#: Spans of buckets, a column, whose borders' weights every task knows.
SPANS = 1024


def bootstrap(df: DataFrame, x: str, y: str, controls: tuple[str, ...] = (), draws: int | None = None, seed: int = 42, most: int = 10000) -> DataFrame:
    """Percentile interval of Spearman's rho with up to two controls, over 1000 (with controls 500) Poisson bootstrap replicates that are each ranked anew. Values are compared as doubles; rows with a null are left out.

    Equal rows are one row with a count, whose weights are made from a hash of the values wherever they are needed. For each column rows are dealt to buckets between quantiles, about ``most`` in each; a value that is a quantile has a bucket of its own, whose ranks follow from its weight alone, so that a frequent value can be dealt to many tasks. Weights of buckets are a table, of which a task gets its own bucket's row; the driver and the tasks know those of at most ``SPANS`` spans of buckets, however many rows there are. A row takes its ranks along from column to column; the last one adds the products up. What it takes is its span, its place there and how far each replicate's rank is from what these let expect, little more than a byte a replicate.
    """
    names, draws = [x, y, *controls], draws or (500 if controls else 1000)
    cols = [f"c{i}" for i in range(len(names))]
    tuples = df.select(*[F.col(n).cast("double").alias(c) for n, c in zip(names, cols)]).dropna().groupBy(*cols).agg(F.count("*").alias("n"))
    rows = source = written(tuples, "tuples").withColumn("k", F.xxhash64(F.lit(seed), *cols))
    cut = max(64, -(-rows.count() // most))
    steps = [i / cut for i in range(1, cut)]
    quantiles = rows.agg(*[F.percentile_approx(c, steps, max(10000, 10 * cut)).alias(c) for c in cols]).first()
    bounds = [np.unique(np.array(quantiles[c] or [], dtype=float)) for c in cols]
    size = [np.zeros((2 * len(b) + 1, 2), dtype=np.int64) for b in bounds]  # rows, and equal ones counted

    def counted(batches):
        sums = [np.zeros_like(s) for s in size]
        for pdf in batches:
            for c, b, s in zip(cols, bounds, sums):
                at = _buckets(pdf[c].to_numpy(), b)
                np.add.at(s, at, np.stack([np.ones_like(at), pdf["n"].to_numpy()], axis=1))
        for i, s in enumerate(sums):
            at = np.flatnonzero(s[:, 0])
            yield pd.DataFrame({"col": i, "bucket": at, "rows": s[at, 0], "n": s[at, 1]})

    for r in rows.mapInPandas(counted, "col int, bucket int, rows long, n long").groupBy("col", "bucket").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).toLocalIterator():
        size[r["col"]][r["bucket"]] = r["rows"], r["n"]

    def weights(pdf):
        k, n = pdf["k"].to_numpy(), pdf["n"].to_numpy()
        return lambda begin, end: poisson_weights(k[begin:end], n[begin:end], draws, seed)

    def summed(pdf):
        take = weights(pdf)
        sums = sum(take(at, at + 1000).sum(axis=0) for at in range(0, len(pdf), 1000))
        return pd.DataFrame([(pdf["bucket"].iloc[0], sums.tobytes())], columns=["bucket", "sums"])

    def joined(batches):
        """One row of those of a bucket that follow each other."""
        bucket, sums = None, 0
        for pdf in batches:
            for b, s in zip(pdf["bucket"], pdf["sums"]):
                if b != bucket and bucket is not None:
                    yield pd.DataFrame([(bucket, sums.tobytes())], columns=["bucket", "sums"])
                bucket, sums = b, np.frombuffer(s, np.int64) + (sums if b == bucket else 0)
        if bucket is not None:
            yield pd.DataFrame([(bucket, sums.tobytes())], columns=["bucket", "sums"])

    def spanned(pdf):
        return pd.DataFrame([(pdf["span"].iloc[0], sum(np.frombuffer(s, np.int64) for s in pdf["sums"]).tobytes())], columns=["span", "sums"])

    def column(i):
        """How rows are dealt for a column, what lies before and in each bucket, and for the last step to come the weights at the borders of spans."""
        b, held = bounds[i], size[i][:, 1]
        parts = np.where(np.arange(len(held)) % 2, np.maximum(1, -(-size[i][:, 0] // most)), 1)
        wide = -(-len(held) // SPANS)
        first = np.arange(len(held)) // wide * wide
        before = np.cumsum(held) - held
        inside = before - before[first]  # of its span, before each bucket
        of = np.add.reduceat(held, np.unique(first))

        @F.pandas_udf("struct<bucket int, part long>")
        def place(v: pd.Series, k: pd.Series) -> pd.DataFrame:
            at = _buckets(v.to_numpy(), b)
            return pd.DataFrame({"bucket": at.astype("int32"), "part": k.to_numpy() % parts[at]})

        at = place(cols[i], "k").alias("at")
        sums = source.select("k", "n", at).select("k", "n", "at.*").groupBy("bucket", "part").applyInPandas(summed, "bucket int, sums binary").mapInPandas(joined, "bucket int, sums binary")
        sums = written(sums, "sums").withColumn("span", F.floor(F.col("bucket") / wide).cast("int"))
        knots = np.zeros((len(of) + 1, draws), dtype=np.int64)
        for r in sums.groupBy("span").applyInPandas(spanned, "span int, sums binary").toLocalIterator():
            knots[r["span"] + 1] = np.frombuffer(r["sums"], np.int64)
        knots = np.cumsum(knots, axis=0)

        def offsets(pdf):
            below, out = knots[pdf["span"].iloc[0]], []
            for bucket, s in pdf.groupby("bucket")["sums"]:
                own = sum(np.frombuffer(x, np.int64) for x in s)
                out.append((bucket, int(parts[bucket]), below.tobytes(), own.tobytes()))
                below = below + own
            return pd.DataFrame(out, columns=["bucket", "parts", "below", "own"])

        ends = sums.groupBy("span").applyInPandas(offsets, "bucket int, parts long, below binary, own binary").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "below", "own")

        def spot(bucket, n):
            """A row's span, and the places of a bucket's rows there."""
            span = bucket // wide
            middle = np.full(len(n), held[bucket] / 2) if bucket % 2 else np.cumsum(n) - n / 2  # equal values have one rank
            return span, ((inside[bucket] + middle) / of[span] * 2**20).astype(np.int64)

        return at, ends, knots, spot

    def in_order(i, pdf, ends):
        """One bucket's rows in the order of a column, with how to weigh them, and their ranks."""
        pdf = pdf.sort_values(cols[i], kind="stable")
        below, own = np.frombuffer(ends["below"].iloc[0], np.int64), np.frombuffer(ends["own"].iloc[0], np.int64)
        take = weights(pdf)
        return pdf, take, _ranked(pdf[cols[i]].to_numpy(), take, below, own if ends["bucket"].iloc[0] % 2 else None)

    def carried(i, knots, spot):
        def go(pdf, ends):
            if pdf.empty:
                return pd.DataFrame({c: [] for c in [*pdf.columns.drop(["bucket", "part"]), f"r{i}", f"b{i}", f"p{i}"]})
            pdf, take, ranks = in_order(i, pdf, ends)
            span, share = spot(int(ends["bucket"].iloc[0]), pdf["n"].to_numpy())
            packed = [x for begin, end, r, _ in ranks for x in _packed(r - _expected(knots, span, share[begin:end]))]
            return pdf.drop(columns=["bucket", "part"]).assign(**{f"r{i}": packed, f"b{i}": np.int32(span), f"p{i}": share})

        return go

    last = len(cols) - 1
    pairs = [(a, b) for a in range(last + 1) for b in range(a, last + 1)]
    product = ["draw", *[f"s_{a}_{b}" for a, b in pairs]]

    def products(known, total):
        def go(pdf, ends):
            if pdf.empty:
                return pd.DataFrame({c: [] for c in product})
            pdf, take, ranks = in_order(last, pdf, ends)
            came = [(pdf[f"b{i}"].to_numpy(), pdf[f"p{i}"].to_numpy(), pdf[f"r{i}"].tolist()) for i in range(last)]
            sums = np.zeros((len(pairs), draws))
            for begin, end, r, w in ranks:
                w = take(begin, end) if w is None else w
                centred = [_unpacked(p[begin:end], draws) + _expected(knots, span[begin:end], share[begin:end]) - (total + 1.0) for (span, share, p), knots in zip(came, known)] + [r - (total + 1.0)]
                for j, (a, b) in enumerate(pairs):
                    sums[j] += (w * centred[a] * centred[b]).sum(axis=0)
            return pd.DataFrame({"draw": np.arange(draws)} | dict(zip(product[1:], sums)))

        return go

    kept, known = ", ".join(f"{c} double" for c in cols) + ", n long, k long", []
    for i in range(len(cols)):
        at, ends, knots, spot = column(i)
        both = rows.select("*", at).select(*rows.columns, "at.*").groupBy("bucket", "part").cogroup(ends.groupBy("bucket", "part"))
        if i < last:
            kept += f", r{i} binary, b{i} int, p{i} long"
            rows = both.applyInPandas(carried(i, knots, spot), kept)
            known.append(knots)
    sums = both.applyInPandas(products(known, knots[-1]), "draw int, " + ", ".join(f"{c} double" for c in product[1:]))
    s = sums.groupBy("draw").agg(*[F.sum(f"s_{a}_{b}").alias(f"s_{a}_{b}") for a, b in pairs])
    c = lambda a, b: F.coalesce(F.try_divide(F.col(f"s_{min(a, b)}_{max(a, b)}"), F.sqrt(f"s_{a}_{a}") * F.sqrt(f"s_{b}_{b}")), F.lit(0.0))
    rhos = s.select(_controlled(c, *range(len(cols))).alias("rho")).agg(F.sort_array(F.collect_list("rho")).alias("rhos"))
    return rhos.select(F.get("rhos", F.lit(int(draws * 0.025))).alias("low"), F.get("rhos", F.lit(int(draws * 0.975))).alias("high"))
