"""Queries of lines followed through commits, over histories made of the orders table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..analytics.rework import rework


def order_hunks(spark, sf_dir):
    """A customer is a file, each order in turn a commit: it appends two to five lines and, but for the first, takes up to two from the top."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    turn = Window.partitionBy("life").orderBy("day", "k")  # one customer's orders
    k = F.col("k")
    removed = F.when(F.row_number().over(turn) == 1, 0).otherwise(k % 3)
    rows = o.select(F.col("o_custkey").cast("string").alias("life"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").cast("long").alias("k"))
    rows = rows.select("*", (F.row_number().over(turn) - 1).cast("long").alias("commit"), removed.cast("long").alias("out"), (k % 4 + 2).alias("in"))
    rows = rows.withColumn("had", F.coalesce(F.sum(F.col("in") - F.col("out")).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hunk = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("out").alias("removed"), F.lit(0).cast("long").alias("added")), F.struct(F.col("had").alias("begin"), F.lit(0).cast("long").alias("removed"), F.col("in").alias("added")))
    at = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    return rows.select(F.lit("r").alias("repo"), "life", F.concat(F.lit("f"), "life").alias("file"), "commit", at.alias("at_micros"), F.explode(hunk).alias("h")).select("repo", "life", "file", "commit", "at_micros", "h.*").where("removed + added > 0")


def churn_rework(spark, sf_dir):
    """Lines of each commit that were taken out within 365 days."""
    return rework(order_hunks(spark, sf_dir), 365).select("file", "commit", "added", "reworked", "left")


QUERIES = {"churn_rework": churn_rework}

ORACLES = {
    "churn_rework": """WITH o AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS commit FROM orders),
s AS (SELECT *, CASE commit WHEN 0 THEN 0 ELSE k % 3 END AS gone, k % 4 + 2 AS added FROM o),
t AS (SELECT *, sum(added) OVER w AS a, sum(gone) OVER w AS g FROM s WINDOW w AS (PARTITION BY c ORDER BY commit))
SELECT 'f' || b.c AS file, b.commit, CAST(b.added AS BIGINT) AS added,
 CAST(coalesce(sum(CASE WHEN r.day - b.day <= 365 THEN least(b.a, r.g) - greatest(b.a - b.added, r.g - r.gone) END), 0) AS BIGINT) AS reworked,
 CAST(b.added - coalesce(sum(CASE WHEN r.c IS NOT NULL THEN least(b.a, r.g) - greatest(b.a - b.added, r.g - r.gone) END), 0) AS BIGINT) AS "left"
FROM t b LEFT JOIN t r ON r.c = b.c AND r.g > b.a - b.added AND r.g - r.gone < b.a AND r.gone > 0 GROUP BY b.c, b.commit, b.added""",
}
