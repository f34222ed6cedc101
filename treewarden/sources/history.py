"""Commit logs, numstat output and observation tables as DataFrames."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..analytics.running import running_sums
from ..functions.scratch import written
from .files import SUFFIX, commit_of


def git_lines(spark: SparkSession, repo: str | Path, *args: str, head: str = "HEAD") -> DataFrame:
    """(repo, value): the lines of a git log; git's own failure is an error."""
    out = subprocess.run(["git", "-C", str(repo), "log", *args, commit_of(repo, head), "--"], capture_output=True, timeout=900, check=True).stdout
    return spark.createDataFrame([(str(repo), x) for x in out.decode("utf-8", "replace").split("\n") if x], "repo string, value string")


def commit_log(lines: DataFrame) -> DataFrame:
    """``value`` as of --format='%H %cI' becomes sha and at; lines whose date can't be read drop out, as some old commits have no real time zone."""
    at = F.try_to_timestamp(F.substring_index(F.trim("value"), " ", -1), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return lines.withColumn("sha", F.substring_index(F.trim("value"), " ", 1)).withColumn("at", at).where("at IS NOT NULL").drop("value")


def renamed_to(name: Column) -> Column:
    """The new name of a rename as --numstat writes it, ``old => new`` or ``folder/{old => new}/rest``; other names as they are."""
    inner = F.regexp_replace(name, r"\{(?:[^{}]*) => ([^{}]*)\}", "$1")
    return F.when(name.contains(" => "), F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), "//+", "/"), "^/", "")).otherwise(name)


def numstat(lines: DataFrame, keys: list[str], follow: bool = False) -> DataFrame:
    """``value`` as of --numstat --format= becomes file and churn, lines added and deleted, summed up per keys; only Python files, no binary ones. With ``follow`` the lines of a rename count for the new name."""
    parts = F.split("value", "\t")
    n = [F.expr(f"try_cast(split(value, '\\t')[{i}] AS BIGINT)") for i in (0, 1)]
    name = F.get(parts, F.lit(2))
    rows = lines.where(F.size(parts) == 3).select(*keys, (renamed_to(name) if follow else name).alias("file"), (n[0] + n[1]).alias("lines"))
    return rows.where(F.col("file").endswith(SUFFIX) & F.col("lines").isNotNull()).groupBy(*keys, "file").agg(F.sum("lines").alias("churn"))


def observations(spark: SparkSession, folder: str | Path) -> DataFrame:
    """All CSV files of a folder but combined.csv, counts as whole numbers; a count that is none is an error."""
    paths = [str(p) for p in sorted(Path(folder).glob("*.csv")) if p.name != "combined.csv"]
    if not paths:
        raise FileNotFoundError(f"no observations in {folder}")
    rows = spark.read.csv(paths, header=True, escape='"', multiLine=True, enforceSchema=False)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("loc", "warns_dup", "warns_em", "churn_14d")})


def observed(rows: DataFrame) -> DataFrame:
    """Without files that were not there, renames and tests."""
    file = F.col("file")
    return rows.where((F.col("loc") > 0) & ~file.contains("=>") & ~file.startswith("tests/") & ~file.contains("/tests/"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Rows of labelled CSV files as text columns, an empty label as null."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True, enforceSchema=False)
    return rows.withColumn("label", F.nullif(F.trim("label"), F.lit("")))


def linter_hits(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, code) of another linter's JSON report, an array of hits with filename, location.row and code."""
    rows = spark.read.json(path, multiLine=True, schema="filename string, code string, location struct<row: int>")
    return rows.where("filename IS NOT NULL").select(F.col("filename").alias("path"), F.col("location.row").alias("row"), "code")


def _commits_numbered(lines: DataFrame) -> DataFrame:
    """Lines (repo, n, value) of a log, newest first, with ``commit``: how many lines that begin with @ come up to each. Sums are carried over ranges, so a long log is no single task's."""
    begins = lines.select("repo", "n", "value", F.col("value").startswith("@").cast("int").alias("begins"))
    return running_sums(begins, ["repo"], ["n"], "begins", "commit").drop("begins")


def _dated(lines: DataFrame) -> DataFrame:
    """Lines of a log that aren't heads, each with its commit's number and ``at``."""
    numbered = written(_commits_numbered(lines), "log")
    at = F.try_to_timestamp(F.substring("value", 2, 64), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    heads = numbered.where(F.col("value").startswith("@")).select("repo", "commit", at.alias("at"))
    return numbered.where(~F.col("value").startswith("@")).join(heads, ["repo", "commit"])


def first_commits(lines: DataFrame) -> DataFrame:
    """(repo, file, first) of lines "@<ISO date>" each followed by the names of files added then, numbered by ``n`` within repo: the earliest date of each file."""
    return _dated(lines).where(F.col("value").endswith(SUFFIX)).groupBy("repo", F.col("value").alias("file")).agg(F.min("at").alias("first"))


def lives(lines: DataFrame) -> DataFrame:
    """Lives of names in a log of "@<ISO date>" lines, newest first, each followed by lines of --name-status -M: (repo, file, commit, at, first, first_name).

    A life begins where a file is added, or where another is renamed to its name, and then goes on that one's life: ``first`` and ``first_name`` are where the
    chain of renames began. ``commit`` counts from the newest. Which life a rename goes on is the last one of the old name begun in an older commit; chains are followed by doubling.
    """
    part = F.split("value", "\t")
    status = F.substring(part[0], 1, 1)
    events = _dated(lines).select("repo", "commit", "at", status.alias("status"), F.get(part, F.size(part) - 1).alias("file"), F.when(status == "R", part[1]).alias("old"))
    births = written(events.where("status IN ('A', 'C', 'R')").drop("status"), "births")
    # of a rename, the last life of its old name begun before; of equal commits what asks comes first
    begun = births.select("repo", "file", "commit", F.col("commit").alias("begun"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("to"))
    asked = births.where("old IS NOT NULL").select("repo", F.col("old").alias("file"), "commit", F.lit(None).cast("long").alias("begun"), F.lit(0).alias("kind"), F.col("file").alias("to"))
    earlier = Window.partitionBy("repo", "file").orderBy(F.desc("commit"), "kind").rowsBetween(Window.unboundedPreceding, -1)  # one name's events
    before = begun.unionByName(asked).withColumn("begun", F.last("begun", ignorenulls=True).over(earlier)).where("kind = 0 AND begun IS NOT NULL")
    links = before.select("repo", F.col("to").alias("file"), "commit", F.col("file").alias("up"), F.col("begun").alias("up_commit"))
    links = written(links, "links")
    while True:  # every round doubles how many renames are followed
        above = links.select("repo", F.col("file").alias("up"), F.col("commit").alias("up_commit"), F.col("up").alias("top"), F.col("up_commit").alias("top_commit"))
        links = written(links.join(above, ["repo", "up", "up_commit"], "left").select("repo", "file", "commit", F.coalesce("top", "up").alias("up"), F.coalesce("top_commit", "up_commit").alias("up_commit"), F.col("top").isNotNull().alias("moved")), "links")
        if not links.where("moved").head(1):
            break
        links = links.drop("moved")
    roots = births.select("repo", F.col("file").alias("up"), F.col("commit").alias("up_commit"), F.col("at").alias("first"))
    out = births.drop("old").join(links.drop("moved"), ["repo", "file", "commit"], "left").join(roots, ["repo", "up", "up_commit"], "left")
    return out.select("repo", "file", "commit", "at", F.coalesce("first", "at").alias("first"), F.coalesce("up", "file").alias("first_name"))


def first_commits_of_lives(lines: DataFrame) -> DataFrame:
    """(repo, file, first, first_name) of each name's newest life, renames followed."""
    newest = lives(lines).groupBy("repo", "file").agg(F.min_by(F.struct("first", "first_name"), "commit").alias("life"))
    return newest.where(F.col("file").endswith(SUFFIX)).select("repo", "file", "life.first", "life.first_name")
