"""Queries of comparison, change and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..analytics import statistics as st
from ..operators import findings as fnd
from ..streaming import changes as ch


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reports(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as two reports of findings: ids, files and lines are arithmetic on the key, so each kind of change occurs."""
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    severity = F.when(F.col("o_orderstatus") == "O", "warn").when(F.col("o_orderstatus") == "F", "info").otherwise("block")
    rows = o.select(F.concat(F.lit("i"), k).alias("id"), F.concat(F.lit("a"), k % 4).alias("analyzer_id"), severity.alias("severity"), F.concat(F.lit("f"), k % 50).alias("file"), (k % 97).cast("int").alias("start_line"), (k % 97 + 4).cast("int").alias("end_line"), F.lit("m").alias("message"), k.alias("k"))
    base = rows.where("k % 5 != 0").drop("k")
    head = rows.where("k % 7 != 0").withColumn("start_line", F.col("start_line") + F.when(F.col("k") % 3 == 0, 2).otherwise(0)).withColumn("end_line", F.col("start_line") + 4).drop("k")
    return base, head


_R = """o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'warn' WHEN 'F' THEN 'info' ELSE 'block' END AS severity FROM orders),
d AS (SELECT 'i' || k AS id, k, severity, CASE WHEN k % 5 = 0 AND k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'added' WHEN k % 7 = 0 THEN 'resolved' WHEN k % 3 = 0 THEN 'moved' ELSE 'stable' END AS kind FROM o)"""


def baseline_new(spark, sf_dir):
    base, head = _reports(spark, sf_dir)
    return fnd.new_findings(head, base).select("id", "severity")


def baseline_mark(spark, sf_dir):
    base, head = _reports(spark, sf_dir)
    return fnd.marked(head, base).groupBy("severity").agg(F.count_if("baselined").alias("baselined"), F.count_if(~F.col("baselined")).alias("new"))


def last_of_id(spark, sf_dir):
    """Lineitem rows as findings whose ids repeat: the last of each id in report order."""
    li = _table(spark, sf_dir, "lineitem")
    place = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = li.select(place("i", "l_orderkey").alias("id"), F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")).alias("file"), (F.col("l_suppkey") % 3).cast("int").alias("start_line"), F.concat(F.lit("a"), (F.col("l_linenumber") % 2).cast("string")).alias("analyzer_id"), F.col("l_linenumber").cast("int").alias("end_line"))
    return fnd.last_per_id(rows)


def diff_changes(spark, sf_dir):
    return fnd.compare(*_reports(spark, sf_dir)).select("kind", "id", "severity", "start_line", "from_line")


def diff_summary(spark, sf_dir):
    return fnd.receipt(fnd.compare(*_reports(spark, sf_dir)))


def _snapshots(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("path"), F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return p.where("k % 6 != 0").select("path", F.col("v").cast("string").alias("version")), p.where("k % 4 != 0").select("path", (F.col("v") + (F.col("k") % 5 == 0).cast("int")).cast("string").alias("version"))


_S = "p AS (SELECT 'f' || p_partkey AS path, p_partkey AS k, p_size AS v FROM part)"


def snapshot_diff(spark, sf_dir):
    return ch.snapshot_diff(*_snapshots(spark, sf_dir))


def incremental_merge(spark, sf_dir):
    """Cached rows of unchanged files and fresh rows of changed ones."""
    old, new = _snapshots(spark, sf_dir)
    return ch.merged(old.withColumn("source", F.lit("cached")), new.withColumn("source", F.lit("fresh")), ch.snapshot_diff(old, new))


def version_delta(spark, sf_dir):
    """Each day of events as a version of a set of users: how many are new, and how many went."""
    e = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("version"), F.col("user_id").alias("id"))
    return ch.version_deltas(e)


def debounce_sessions(spark, sf_dir):
    """Changes of one user that follow within 30 minutes are one rescan."""
    e = _table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("user_id").alias("repo"))
    return ch.debounced(e, "30 minutes").select("repo", "began", "changes")


def overlap_band_all(spark, sf_dir):
    """Every lineitem row is read: as a hit with a discount over 0.07, as a finding otherwise. Parts are the files, so that some findings stay uncovered."""
    li = _table(spark, sf_dir, "lineitem")
    line = F.col("l_quantity").cast("int")
    found = li.where("NOT coalesce(l_discount > 0.07, false)").select(F.concat(F.lit("f"), F.col("l_partkey")).alias("file"), line.alias("line"))
    hits = li.where("l_discount > 0.07").select(F.concat(F.lit("f"), F.col("l_partkey")).alias("path"), line.alias("row"))
    return st.band_overlap(found, hits).groupBy("file").agg(F.count("*").alias("findings"), F.count_if("covered").alias("covered"))


def overlap_totals(spark, sf_dir):
    """Totals over all rows of what overlap_band_all counts by file."""
    li = _table(spark, sf_dir, "lineitem")
    line = F.col("l_quantity").cast("int")
    found = li.where("NOT coalesce(l_discount > 0.07, false)").select(F.concat(F.lit("f"), F.col("l_partkey")).alias("file"), line.alias("line"))
    hits = li.where("l_discount > 0.07").select(F.concat(F.lit("f"), F.col("l_partkey")).alias("path"), line.alias("row"))
    return st.overlap_totals(st.band_overlap(found, hits))


def _warnings(spark, sf_dir):
    """Orders as findings of three analyzers in fifty files."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "dup.block").when(k % 4 == 1, "risk.error-masking").otherwise("other")
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), k % 50).alias("file"), F.when(F.col("o_orderstatus") == "O", "warn").otherwise("info").alias("severity"), name.alias("analyzer_id"))


def warns_by_file(spark, sf_dir):
    return st.warns_per_file(_warnings(spark, sf_dir))


def warns_and_churn(spark, sf_dir):
    """Every file with warnings or changes; lineitem rows are changes of sixty files."""
    churned = _table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_orderkey") % 60 + 10).alias("file")).agg(F.sum(F.col("l_quantity").cast("long")).alias("churn"))
    return st.warns_and_churn(st.warns_per_file(_warnings(spark, sf_dir)), churned)


def repo_ranges(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_custkey").alias("sha"), F.col("o_orderdate").alias("at"), F.concat(F.lit("f"), F.col("o_orderkey") % 50).alias("file"))
    return st.repo_ranges(o)


def commit_sample(spark, sf_dir):
    """A sampling operator: 100 orders as commits, at least 14 days before 1998."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("at"))
    return st.sampled_commits(o, 100, F.lit("1998-01-01 00:00:00").cast("timestamp"))


def phase_times(spark, sf_dir):
    """Events of a user as phases: milliseconds since the one before."""
    e = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("repo"), F.col("ts").alias("at")).agg(F.min("event_type").alias("phase"))
    return ch.elapsed(e)


def changed_paths(spark, sf_dir):
    """The first twenty changed paths of two snapshots, a top-k report."""
    return ch.first_changed(ch.snapshot_diff(*_snapshots(spark, sf_dir)))


def sample_quota(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("available"))
    return st.quotas(d, 100)


def stratified_sample(spark, sf_dir):
    """A sampling operator: 100 documents by the quotas of their sources."""
    return st.stratified(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 100)


def label_score(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_table(spark, sf_dir, "labels"), "doc_id")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "tp").when((F.col("quality") == 0) & (F.col("toxic") == 0), "fp").when(F.col("quality") == 1, "style").when(F.col("doc_id") % 2 == 0, "boilerplate").otherwise("unclear")
    return st.label_scores(d.select(F.col("source").alias("repo"), F.col("lang").alias("kind"), label.alias("label")))


def churn_14d_all(spark, sf_dir):
    """Every order, with the changes of every lineitem row."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("f"), F.col("o_custkey") % 100).alias("file"), F.col("o_orderdate").alias("at"))
    c = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey") % 100).alias("file"), F.col("l_shipdate").alias("changed_at"), F.col("l_quantity").cast("long").alias("lines"))
    return st.churn(o, c)


def file_age_all(spark, sf_dir):
    """Whole days from a customer's first order to each order; customers are the files."""
    o = _table(spark, sf_dir, "orders").select(F.lit("r").alias("repo"), F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("at"), "o_orderkey")
    return st.file_age(o, o.groupBy("repo", "file").agg(F.min("at").alias("first"))).select("o_orderkey", "age_days")


def _observations(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 100).alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("w"))


GROUP = ["l_returnflag", "l_linestatus"]


def _rho(*controls):
    return lambda spark, sf_dir: st.spearman(_observations(spark, sf_dir), "x", "y", GROUP, controls).withColumn("rho", F.round("rho", 6))


def fisher_z(spark, sf_dir):
    return st.fisher_mean(st.spearman(_observations(spark, sf_dir), "x", "y", GROUP)).select("groups", *[F.round(c, 6).alias(c) for c in ("rho", "low", "high")])


def bootstrap_interval(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), "o_orderkey")
    return st.bootstrap(o, "x", "y")


QUERIES = {
    f.__name__: f
    for f in (baseline_new, baseline_mark, last_of_id, diff_changes, diff_summary, snapshot_diff, incremental_merge, version_delta, debounce_sessions, overlap_band_all, overlap_totals, warns_by_file, warns_and_churn, repo_ranges, commit_sample, phase_times, changed_paths, sample_quota, stratified_sample, label_score, churn_14d_all, file_age_all, fisher_z, bootstrap_interval)
} | {"overlap_band": overlap_band_all, "churn_14d": churn_14d_all, "file_age": file_age_all, "spearman": _rho(), "partial_spearman": _rho("z"), "partial_spearman_2": _rho("z", "w")}

_RANKS = """WITH o AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, round(l_extendedprice / 100) AS y, l_discount AS z, l_tax AS w FROM lineitem),
r AS (SELECT l_returnflag, l_linestatus, """ + ", ".join(f"rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, {c}) - 1) / 2.0 AS {c}" for c in "xyzw") + """ FROM o),
g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, corr(x, w) AS xw, corr(y, w) AS yw, corr(z, w) AS zw FROM r GROUP BY ALL)"""
_ONCE = "(({0} - {1} * {2}) / sqrt((1 - {1} * {1}) * (1 - {2} * {2})))"

_WARNS = "w AS (SELECT 'f' || (o_orderkey % 50) AS file, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS warns_dup, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS warns_em FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"

ORACLES = {
    "baseline_new": f"WITH {_R} SELECT id, severity FROM d WHERE kind = 'added'",
    "baseline_mark": f"WITH {_R} SELECT severity, count(*) FILTER (WHERE kind IN ('moved', 'stable')) AS baselined, count(*) FILTER (WHERE kind = 'added') AS new FROM d WHERE kind IS NOT NULL AND kind <> 'resolved' GROUP BY severity",
    "last_of_id": """WITH r AS (SELECT 'i' || l_orderkey AS id, 'f' || (l_partkey % 7) AS file, CAST(l_suppkey % 3 AS INTEGER) AS start_line, 'a' || (l_linenumber % 2) AS analyzer_id, CAST(l_linenumber AS INTEGER) AS end_line FROM lineitem)
 SELECT id, file, start_line, analyzer_id, end_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file DESC, start_line DESC, analyzer_id DESC, end_line DESC) AS n FROM r) WHERE n = 1""",
    "diff_changes": f"WITH {_R} SELECT kind, id, severity, CAST(k % 97 + CASE WHEN kind IN ('added', 'moved') AND k % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS start_line, CASE WHEN kind = 'moved' THEN CAST(k % 97 AS INTEGER) END AS from_line FROM d WHERE kind IS NOT NULL",
    "diff_summary": f"WITH {_R} SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}' AND severity = '{s}') AS {k}_{s}" for k in ("added", "resolved", "moved") for s in ("block", "warn", "info")) + ", count(*) FILTER (WHERE kind = 'stable') AS stable FROM d",
    "snapshot_diff": f"WITH {_S} SELECT path, CASE WHEN k % 6 = 0 THEN 'added' WHEN k % 4 = 0 THEN 'deleted' ELSE 'modified' END AS status FROM p WHERE NOT (k % 6 = 0 AND k % 4 = 0) AND (k % 6 = 0 OR k % 4 = 0 OR k % 5 = 0)",
    "incremental_merge": f"WITH {_S} SELECT path, CAST(v + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS version, CASE WHEN k % 6 = 0 OR k % 5 = 0 THEN 'fresh' ELSE 'cached' END AS source FROM p WHERE k % 4 <> 0",
    "version_delta": """WITH e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS version, user_id AS id FROM events), v AS (SELECT version, lag(version) OVER (ORDER BY version) AS prev FROM (SELECT DISTINCT version FROM e))
 SELECT v.version, (SELECT count(*) FROM e WHERE e.version = v.version AND NOT EXISTS (SELECT 1 FROM e p WHERE p.version = v.prev AND p.id = e.id)) AS new, (SELECT count(*) FROM e WHERE e.version = v.prev AND NOT EXISTS (SELECT 1 FROM e p WHERE p.version = v.version AND p.id = e.id)) AS gone FROM v""",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
 s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id AS repo, min(ts) AS began, count(*) AS changes FROM s GROUP BY user_id, n""",
    "overlap_band_all": """WITH f AS (SELECT 'f' || l_partkey AS file, trunc(l_quantity) AS line FROM lineitem WHERE NOT coalesce(l_discount > 0.07, false)), h AS (SELECT DISTINCT 'f' || l_partkey AS path, trunc(l_quantity) AS row FROM lineitem WHERE l_discount > 0.07)
 SELECT file, count(*) AS findings, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM h WHERE path = file AND abs(h.row - line) <= 3)) AS covered FROM f GROUP BY file""",
    "overlap_totals": """WITH f AS (SELECT 'f' || l_partkey AS file, trunc(l_quantity) AS line FROM lineitem WHERE NOT coalesce(l_discount > 0.07, false)), h AS (SELECT DISTINCT 'f' || l_partkey AS path, trunc(l_quantity) AS row FROM lineitem WHERE l_discount > 0.07),
 m AS (SELECT EXISTS (SELECT 1 FROM h WHERE path = file AND abs(h.row - line) <= 3) AS covered FROM f), t AS (SELECT count(*) AS findings, count(*) FILTER (WHERE covered) AS covered, count(*) FILTER (WHERE NOT covered) AS unique FROM m)
 SELECT *, round(100.0 * covered / findings, 1) AS covered_pct, round(100.0 * "unique" / findings, 1) AS unique_pct FROM t""",
    "warns_by_file": f"WITH {_WARNS} SELECT * FROM w",
    "warns_and_churn": f"WITH {_WARNS}, c AS (SELECT 'f' || (l_orderkey % 60 + 10) AS file, sum(CAST(trunc(l_quantity) AS BIGINT)) AS churn FROM lineitem GROUP BY 1) SELECT file, coalesce(warns_dup, 0) AS warns_dup, coalesce(warns_em, 0) AS warns_em, CAST(coalesce(churn, 0) AS BIGINT) AS churn FROM w FULL JOIN c USING (file)",
    "repo_ranges": "SELECT o_orderpriority AS repo, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n_rows, count(DISTINCT o_custkey) AS commits, count(DISTINCT o_orderkey % 50) AS files FROM orders GROUP BY 1",
    "commit_sample": "SELECT o_orderkey AS sha, o_orderdate AS at FROM orders WHERE o_orderdate <= TIMESTAMP '1997-12-18' ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100",
    "phase_times": """WITH e AS (SELECT user_id AS repo, ts AS "at", min(event_type) AS phase FROM events GROUP BY 1, 2), b AS (SELECT *, lag("at") OVER (PARTITION BY repo ORDER BY "at") AS before FROM e)
 SELECT repo, "at", phase, (epoch_us("at") - epoch_us(before)) // 1000 AS prev_ms FROM b""",
    "changed_paths": f"WITH {_S} SELECT path FROM p WHERE NOT (k % 6 = 0 AND k % 4 = 0) AND (k % 6 = 0 OR k % 4 = 0 OR k % 5 = 0) ORDER BY path LIMIT 20",
    "stratified_sample": """WITH g AS (SELECT source AS name, count(*) AS available, least(3, count(*)) AS first FROM documents GROUP BY source), t AS (SELECT *, available - first AS weight, 100 - sum(first) OVER () AS remaining, greatest(sum(available - first) OVER (), 1) AS total FROM g),
 q AS (SELECT name, first + greatest(0, CASE WHEN remaining > 0 THEN least(round_even(remaining * weight / total, 0), weight) ELSE 0 END) AS quota FROM t),
 n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, source FROM n JOIN q ON name = source WHERE n <= quota""",
    "sample_quota": """WITH g AS (SELECT source AS name, count(*) AS available, least(3, count(*)) AS first FROM documents GROUP BY source), t AS (SELECT *, available - first AS weight, 100 - sum(first) OVER () AS remaining, greatest(sum(available - first) OVER (), 1) AS total FROM g)
 SELECT name, available, CAST(first + greatest(0, CASE WHEN remaining > 0 THEN least(round_even(remaining * weight / total, 0), weight) ELSE 0 END) AS BIGINT) AS quota FROM t""",
    "label_score": """WITH l AS (SELECT source AS repo, lang AS kind, CASE WHEN quality = 1 AND toxic = 0 THEN 'tp' WHEN quality = 0 AND toxic = 0 THEN 'fp' WHEN quality = 1 THEN 'style' WHEN doc_id % 2 = 0 THEN 'boilerplate' ELSE 'unclear' END AS label FROM documents JOIN labels USING (doc_id)),
 g AS (SELECT repo, kind, count(*) FILTER (WHERE label = 'tp') AS tp, count(*) FILTER (WHERE label = 'fp') AS fp, count(*) FILTER (WHERE label = 'boilerplate') AS boilerplate, count(*) FILTER (WHERE label = 'style') AS style, count(*) FILTER (WHERE label = 'unclear') AS unclear, count(*) AS labeled FROM l GROUP BY GROUPING SETS ((), (repo), (kind))),
 p AS (SELECT *, CASE WHEN labeled - unclear - boilerplate > 0 THEN round(tp / (labeled - unclear - boilerplate), 6) END AS precision, round(tp / labeled, 6) AS actionable FROM g) SELECT *, CASE WHEN tp >= 0.4 * labeled THEN 'pass' WHEN tp >= 0.2 * labeled THEN 'threshold' ELSE 'redesign' END AS gate FROM p""",
    "churn_14d_all": """WITH o AS (SELECT o_orderkey AS key, 'f' || (o_custkey % 100) AS file, o_orderdate AS since FROM orders), c AS (SELECT 'f' || (l_orderkey % 100) AS file, l_shipdate AS changed_at, CAST(trunc(l_quantity) AS BIGINT) AS lines FROM lineitem)
 SELECT key, o.file, CAST(coalesce(sum(lines), 0) AS BIGINT) AS churn FROM o LEFT JOIN c ON c.file = o.file AND changed_at BETWEEN since AND since + INTERVAL 14 DAY GROUP BY key, o.file""",
    "file_age_all": """WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY o_custkey) SELECT o_orderkey, CAST(greatest(floor((epoch(o_orderdate) - epoch(first)) / 86400), 0) AS BIGINT) AS age_days FROM orders LEFT JOIN f USING (o_custkey)""",
    "spearman": _RANKS + " SELECT l_returnflag, l_linestatus, n, round(xy, 6) AS rho FROM g",
    "partial_spearman": _RANKS + f" SELECT l_returnflag, l_linestatus, n, round({_ONCE.format('xy', 'xz', 'yz')}, 6) AS rho FROM g",
    "partial_spearman_2": _RANKS + f", h AS (SELECT *, {_ONCE.format('xy', 'xz', 'yz')} AS a, {_ONCE.format('xw', 'xz', 'zw')} AS b, {_ONCE.format('yw', 'yz', 'zw')} AS c FROM g) SELECT l_returnflag, l_linestatus, n, round({_ONCE.format('a', 'b', 'c')}, 6) AS rho FROM h",
    "fisher_z": _RANKS + """, f AS (SELECT count(*) AS groups, sum(atanh(xy) * (n - 3)) / sum(n - 3) AS m, 1 / sqrt(sum(n - 3)) AS se FROM g WHERE n >= 30)
 SELECT groups, round((exp(2 * m) - 1) / (exp(2 * m) + 1), 6) AS rho, round((exp(2 * (m - 1.96 * se)) - 1) / (exp(2 * (m - 1.96 * se)) + 1), 6) AS low, round((exp(2 * (m + 1.96 * se)) - 1) / (exp(2 * (m + 1.96 * se)) + 1), 6) AS high FROM f""",
}
ORACLES |= {n: ORACLES[f"{n}_all"] for n in ("overlap_band", "churn_14d", "file_age")}  # the short names, which once read a part of the tables
