"""A whole check, and the command line: python -m treewarden.plans.check check PATH [--json] [--baseline] [--exit-code]."""

from __future__ import annotations

import argparse
import html
import json
import sys
import textwrap
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..operators.analyzers import REGISTRY
from ..operators.findings import ORDER, analyze, compare, exit_code, markdown, new_findings, receipt_document, summary
from ..operators.nodes import node_table, parse_errors
from ..sources import baseline as bl
from ..sources.files import full_scan, with_content
from ..sources.trees import read_trees, written_pushing


COLORS = {"block": "\x1b[35m", "warn": "\x1b[33m", "info": "\x1b[36m"}
MOST_ERRORS = 20


def check(spark: SparkSession, repos: list[str], only: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, files, and errors (path, kind, message) of the trees; each file is read once and parsed once, into written tables. Files that can't be read or parsed have an error and no findings.

    ``only`` names the analyzers that run. Where all of them look at test modules alone, no other file is opened.
    """
    if only and (unknown := set(only) - set(REGISTRY)):
        raise ValueError(f"no such analyzer: {', '.join(sorted(unknown))}")
    if only and all(REGISTRY[n].tests_only for n in only):
        files = written_pushing(read_trees(spark, repos, push=True).where("test"), "files")
    else:
        files = written(with_content(written(full_scan(spark, repos), "listing")), "files")
    readable = files.where("error IS NULL")
    table = node_table(readable)
    errors = files.where("error IS NOT NULL").select("path", F.substring_index("error", ":", 1).alias("kind"), F.col("error").alias("message")).unionByName(parse_errors(table).select("path", F.lit("SyntaxError").alias("kind"), "message"))
    return written(analyze(table, readable, only), "findings"), files, errors


def as_dict(row) -> dict:
    """A finding as reports have it: the span as a pair, evidence parsed."""
    f = row.asDict()
    f.pop("repo", None)
    f["span"], f["evidence"] = [f.pop("start_line"), f.pop("end_line")], json.loads(f["evidence"])
    return f


def head(findings: DataFrame, repo: str, n_files: int, errors: DataFrame) -> dict:
    """A report without its findings: counts, and the first errors with their total."""
    listed = [r.asDict() for r in errors.orderBy("path").limit(MOST_ERRORS).collect()]
    n = {r["kind"] == "SyntaxError": r["count"] for r in errors.groupBy((F.col("kind") == "SyntaxError").alias("kind")).count().withColumn("kind", F.when(F.col("kind"), "SyntaxError").otherwise("")).collect()}
    counts = summary(findings).first().asDict() | {"files_scanned": n_files, "files_unreadable": n.get(False, 0), "files_unparsed": n.get(True, 0)}
    return {"schema": 1, "repo": repo, "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "scope": {"kind": "full", "base": None, "head": "working"}, "summary": counts, "errors": listed, "errors_total": sum(n.values())}


def write_report(out, findings: DataFrame, top: dict) -> None:
    """The report as JSON, finding by finding, so that no more than a part of the findings is on the driver."""
    out.write(json.dumps(top, indent=2)[:-2] + ',\n  "findings": [')
    for i, r in enumerate(findings.orderBy(*ORDER).toLocalIterator()):
        out.write(("," if i else "") + "\n" + textwrap.indent(json.dumps(as_dict(r), indent=2), "    "))
    out.write("\n  ]\n}\n")


#: Rows are hidden that have another severity than the one chosen, or lack the text typed in.
_FILTER = "function f(){for(const r of document.querySelectorAll('tbody tr'))r.hidden=s.value&&r.className!=s.value||!r.textContent.toLowerCase().includes(q.value.toLowerCase())}"


def page(data: dict) -> str:
    """A page that shows a report, by severity and text; its JSON is embedded so that no script can end early."""
    rank = {"block": 0, "warn": 1, "info": 2}
    rows = "".join(f"<tr class={f['severity']}><td>{f['severity']}</td><td>{html.escape(f['file'])}:{f['span'][0]}</td><td>{f['analyzer_id']}</td><td>{html.escape(f['message'])}</td></tr>" for f in sorted(data["findings"], key=lambda f: (rank[f["severity"]], f["file"], f["span"][0])))
    choice = "".join(f"<option>{s}</option>" for s in ("", *rank))
    return f"<!DOCTYPE html><meta charset=utf-8><title>Findings</title><script>{_FILTER}</script><select id=s onchange=f()>{choice}</select><input id=q oninput=f()><table><tbody>{rows}</tbody></table><script type=application/json id=data>{json.dumps(data).replace('</', '<' + chr(92) + '/')}</script>\n"




def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A report's findings, and its repo and time. A task reads the report, the driver gets its head alone; what isn't a report with findings is an error."""
    fields = "id string, analyzer_id string, analyzer_version string, severity string, file string, span array<int>, symbol string, message string, evidence string"
    report = spark.read.json(Path(path).resolve().as_uri(), multiLine=True, mode="FAILFAST", schema=f"repo string, generated_at string, findings array<struct<{fields.replace(' string', ': string').replace(' array', ': array')}>>")
    top = report.select("repo", "generated_at", F.col("findings").isNotNull().alias("whole")).first()
    if top is None or not top["whole"]:
        raise ValueError(f"{path} is no report")
    rows = report.select(F.explode("findings").alias("f")).select("f.*")
    span = [F.col("span")[i].alias(c) for i, c in enumerate(("start_line", "end_line"))]
    return rows.select("id", "analyzer_id", "analyzer_version", "severity", "file", *span, "symbol", "message", "evidence"), {"repo": top["repo"], "generated_at": top["generated_at"]}


def print_table(findings: DataFrame, out, color: bool) -> None:
    """Severity, place and message in columns; places of up to 60 characters are aligned."""
    place = F.concat("file", F.lit(":"), "start_line")
    width = min(60, findings.agg(F.max(F.length(place))).first()[0] or 0)
    for r in findings.orderBy(*ORDER).withColumn("place", place).toLocalIterator():
        name = f"{r['severity']:5}"
        out.write(f"  {COLORS[r['severity']] + name + chr(27) + '[0m' if color else name}  {r['place']:{width}}  [{r['analyzer_id']}] {r['message']}\n")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("treewarden")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "baseline", "report"):
        p = sub.add_parser(name)
        p.add_argument("repo")
        p.add_argument("--json", action="store_true")
        p.add_argument("--baseline", action="store_true")
        p.add_argument("--exit-code", action="store_true")
        p.add_argument("--at", choices=("info", "warn", "block"), default="warn")
        p.add_argument("--out")
        p.add_argument("--only", action="append")
    p = sub.add_parser("diff")
    p.add_argument("base")
    p.add_argument("head")
    p.add_argument("--markdown", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("treewarden").getOrCreate()
    if a.command == "diff":
        (base, b), (now, h) = read_report(spark, a.base), read_report(spark, a.head)
        changes = written(compare(base, now), "changes")
        print(markdown(changes) if a.markdown else json.dumps(json.loads(receipt_document(changes, b, h).toJSON().first()), indent=2))
        return 0
    root = Path(a.repo).resolve()
    if not root.is_dir():
        print(f"error: {root} is no folder", file=sys.stderr)
        return 2
    where = root / ".treewarden" / "baseline.json"
    found, files, errors = check(spark, [a.repo], a.only) if a.only else check(spark, [a.repo])
    n_files = files.where("error IS NULL").count()
    top = head(found, str(root), n_files, errors)
    for e in top["errors"]:
        print(f"error: {e['path']}: {e['message']}", file=sys.stderr)
    if top["errors_total"] > len(top["errors"]):
        print(f"error: {top['errors_total']} files in all", file=sys.stderr)
    failed = 2 if top["summary"]["files_unreadable"] else 0
    if a.command == "baseline":
        print(f"baseline: {bl.save(found, where)} ids -> {where}")
        return failed
    if a.baseline:
        known = bl.load(spark, where)
        if known is None:
            print(f"warn: no baseline at {where}", file=sys.stderr)
        found = new_findings(found, known)
        top["summary"] |= summary(found).first().asDict()
    if a.command == "report":
        out = Path(a.out or root / "treewarden-report.html")
        out.write_text(page(top | {"findings": [as_dict(r) for r in found.orderBy(*ORDER).toLocalIterator()]}), encoding="utf-8")
        print(out)
    elif a.json:
        write_report(sys.stdout, found, top)
    else:
        print_table(found, sys.stdout, sys.stdout.isatty())
    return failed or (exit_code(found, a.at).first()[0] if a.exit_code else 0)


if __name__ == "__main__":
    sys.exit(main())
