"""Findings: union, ids, envelope, baseline and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import finding_ids
from ..functions.scratch import written
from .analyzers import REGISTRY

RANK = {"info": 0, "warn": 1, "block": 2}
ORDER = ["file", "start_line", "analyzer_id", "id"]


def analyze(nodes: DataFrame, files: DataFrame, only: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Findings of the analyzers over one node table."""
    found = reduce(DataFrame.unionByName, [a.run(nodes, files) for name, a in REGISTRY.items() if only is None or name in only])
    return found.withColumn("id", finding_ids("analyzer_id", "analyzer_version", "symbol", "file", "evidence")) if ids else found


def analyze_apart(nodes: DataFrame, files: DataFrame, only: list[str] | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
    """Each analyzer's findings, run and written by itself, and a row (analyzer_id, kind, message) for each that failed; the others' findings are not touched by it."""
    found, errors = {}, []
    for name in REGISTRY if only is None else only:
        try:
            found[name] = written(analyze(nodes, files, [name]), "findings")
        except Exception as e:  # whatever an analyzer of somebody else raises, in planning or in a task
            errors.append({"analyzer_id": name, "kind": type(e).__name__, "message": str(e)[:200]})
    return found, errors


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s}") for s in ("block", "warn", "info")]


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(*severity_counts())


def analyzer_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("analyzer_id").agg(*severity_counts(), F.count("*").alias("total")).orderBy(F.desc("total"), "analyzer_id")


def exit_code(findings: DataFrame, at: str = "warn") -> DataFrame:
    """One row: 1 if any finding is as severe as ``at``, else 0."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in RANK.items()])
    return findings.agg(F.coalesce(F.max((rank >= RANK[at]).cast("int")), F.lit(0)).alias("exit_code"))


def new_findings(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Findings whose id is not in the baseline; no baseline hides nothing."""
    return findings if baseline is None else findings.join(baseline.select("id").distinct(), "id", "left_anti")


def marked(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    known = baseline.select("id").distinct().withColumn("baselined", F.lit(True))
    return findings.join(known, "id", "left").withColumn("baselined", F.coalesce("baselined", F.lit(False)))


def with_rationale(findings: DataFrame, rationales: DataFrame) -> DataFrame:
    """Findings with their analyzer's text of ``rationales`` (analyzer_id, rationale), a row an analyzer; empty without one. Spark broadcasts them if they are small."""
    return findings.join(rationales.select("analyzer_id", "rationale"), "analyzer_id", "left").withColumn("rationale", F.coalesce("rationale", F.lit("")))


def last_per_id(findings: DataFrame) -> DataFrame:
    """Of rows that share an id the last in report order."""
    order = Window.partitionBy("id").orderBy(*[F.desc(c) for c in ORDER[:-1]], F.desc("end_line"))
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


SIDES = ["analyzer_id", "severity", "file", "start_line", "end_line", "symbol", "message"]


def compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """added, resolved, moved and stable findings of two reports, with both places of those that moved. Reports without symbols have null ones."""

    def side(report: DataFrame, name: str) -> DataFrame:
        report = report if "symbol" in report.columns else report.withColumn("symbol", F.lit(None).cast("string"))
        return last_per_id(report).select("id", *[F.col(c).alias(f"{name}_{c}") for c in SIDES])

    both = side(base, "b").join(side(head, "h"), "id", "full_outer")
    moved = (F.col("b_file") != F.col("h_file")) | (F.col("b_start_line") != F.col("h_start_line")) | (F.col("b_end_line") != F.col("h_end_line"))
    kind = F.when(F.col("b_file").isNull(), "added").when(F.col("h_file").isNull(), "resolved").when(moved, "moved").otherwise("stable")
    pick = [F.coalesce(f"h_{c}", f"b_{c}").alias(c) for c in SIDES]
    return both.select(kind.alias("kind"), "id", *pick, *[F.when(kind == "moved", F.col(f"b_{c}")).alias(n) for c, n in (("file", "from_file"), ("start_line", "from_line"), ("end_line", "from_end"))])


def receipt(changes: DataFrame) -> DataFrame:
    """Numbers of changes by kind and severity, one row."""
    return changes.agg(*[F.count_if((F.col("kind") == k) & (F.col("severity") == s)).alias(f"{k}_{s}") for k in ("added", "resolved", "moved") for s in ("block", "warn", "info")], F.count_if(F.col("kind") == "stable").alias("stable"))


def receipt_document(changes: DataFrame, base: dict, head: dict) -> DataFrame:
    """One row in the shape of the comparison's report: schema, base and head (repo, generated_at), summary by kind and severity, and the changes of each kind. As large as all changes, so for one repository."""
    place = lambda f, a, b: F.struct(F.col(f).alias("file"), F.array(a, b).alias("span"))
    row = F.struct("id", "analyzer_id", "severity", "file", F.array("start_line", "end_line").alias("span"), "symbol", "message")
    whole = F.struct(*[row[c].alias(c) for c in ("id", "analyzer_id", "severity", "file", "span", "symbol", "message")], place("from_file", "from_line", "from_end").alias("from"), place("file", "start_line", "end_line").alias("to"))
    counts = [F.struct(*[F.count_if((F.col("kind") == k) & (F.col("severity") == s)).alias(s) for s in ("block", "warn", "info")]).alias(k) for k in ("added", "resolved", "moved")]
    listed = lambda k, r: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("file", "start_line", "id", r.alias("r"))))), lambda x: x["r"]).alias(k)
    ends = [F.struct(*[F.lit(x.get(c)).cast("string").alias(c) for c in ("repo", "generated_at")]).alias(n) for n, x in (("base", base), ("head", head))]
    return changes.agg(F.struct(*counts, F.count_if(F.col("kind") == "stable").alias("stable")).alias("summary"), F.struct(listed("added", row), listed("resolved", row), listed("moved", whole)).alias("changes")).select(F.lit(1).alias("schema"), *ends, "summary", "changes")


def markdown(changes: DataFrame, most: int = 10) -> str:
    """A comparison as one table: a line for each kind of change that matters (informational findings never do) with its number, then its first ``most`` findings. Empty without any.

    Spark writes the lines; at most ``most`` + 1 of a kind reach the driver.
    """
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    loud = changes.where("severity != 'info' AND kind != 'stable'")
    numbers = loud.groupBy("kind").agg(F.count("*").alias("all"))
    order = Window.partitionBy("kind").orderBy("file", "start_line", "analyzer_id", "id")
    listed = loud.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    place = F.concat(cell("file"), F.lit(":"), "start_line", F.coalesce(F.concat(F.lit(", before "), cell("from_file"), F.lit(":"), "from_line"), F.lit("")))
    lines = listed.select("kind", "n", F.concat_ws(" | ", F.lit(""), F.lit(" "), "severity", place, cell("analyzer_id"), cell("message"), F.lit("")).alias("line"))
    left = F.when(F.col("all") > most, F.concat(F.lit("first "), F.lit(str(most)))).otherwise("all")
    heads = numbers.select("kind", F.lit(0).alias("n"), F.concat_ws(" | ", F.lit(""), F.concat(F.lit("**"), "kind", F.lit("**")), F.col("all").cast("string"), left, F.lit(" "), F.lit(" "), F.lit("")).alias("line"))
    rows = [r["line"].strip() for r in heads.unionByName(lines).orderBy("kind", "n").collect()]
    return "\n".join(["| change | severity | place | analyzer | message |", "|-|-|-|-|-|", *rows, ""]) if rows else ""
