import datetime
import subprocess

import pytest

from treewarden.analytics import statistics as st
from treewarden.operators.findings import with_rationale
from treewarden.sources import history


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_logs(spark, tmp_path):
    lines = spark.createDataFrame([(v,) for v in ("a1 2024-01-02T03:04:05+09:00", "b2 2024-01-02T03:04:05Z", "c3 2024-01-02T03:04:05+518:00", "d4 2024-01-02T03:04:05-05:30")], "value string")
    got = {r["sha"]: r["t"] for r in history.commit_log(lines).selectExpr("sha", "unix_seconds(at) AS t").collect()}
    assert got == {s: int(datetime.datetime.fromisoformat(t).timestamp()) for s, t in (("a1", "2024-01-02T03:04:05+09:00"), ("b2", "2024-01-02T03:04:05+00:00"), ("d4", "2024-01-02T03:04:05-05:30"))}
    stat = spark.createDataFrame([("r", v) for v in ("1\t2\ta.py", "3\t0\ta.py", "-\t-\tb.py", "5\t5\tc.md", "x", "", "0\t0\td.py", "1\t1\te.py\tf")], "repo string, value string")
    assert rows(history.numstat(stat, ["repo"])) == [("r", "a.py", 6), ("r", "d.py", 0)]
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b"]
    subprocess.run([*git, "init", "-q"], check=True)
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    subprocess.run([*git, "add", "a.py"], check=True)
    subprocess.run([*git, "commit", "-qm", "one"], check=True)
    assert history.commit_log(history.git_lines(spark, tmp_path, "--format=%H %cI")).count() == 1
    assert rows(history.numstat(history.git_lines(spark, tmp_path, "--numstat", "--format="), [])) == [("a.py", 2)]


def test_observations(spark, tmp_path):
    head = "repo,sha,date,file,loc,warns_dup,warns_em,churn_14d\n"
    (tmp_path / "one.csv").write_text(head + 'r,s,d,"a,""b"".py",5,1,0,7\nr,s,d,gone.py,0,0,0,3\nr,s,d,{a => b}.py,4,0,0,3\n')
    (tmp_path / "two.csv").write_text(head + "q,s,d,tests/x.py,5,1,0,7\nq,s,d,a/tests/x.py,5,1,0,7\nq,s,d,a/tests.py,5,1,2,7\n")
    (tmp_path / "combined.csv").write_text(head + "z,s,d,z.py,5,1,0,7\n")
    found = history.observations(spark, tmp_path)
    assert found.count() == 6
    assert rows(history.observed(found).select("file", "loc", "warns_em")) == [('a,"b".py', 5, 0), ("a/tests.py", 5, 2)]
    (tmp_path / "two.csv").write_text(head + "q,s,d,x.py,many,1,0,7\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        history.observations(spark, tmp_path).collect()


def test_joins(spark):
    found = spark.createDataFrame([("a.py", "warn", "dup.block"), ("a.py", "warn", "dup.block"), ("a.py", "info", "dup.block"), ("b.py", "warn", "risk.error-masking"), ("c.py", "warn", "other"), ("e.py", "info", "other")], "file string, severity string, analyzer_id string")
    warns = st.warns_per_file(found)
    assert rows(warns) == [("a.py", 2, 0), ("b.py", 0, 1), ("c.py", 0, 0)]
    churn = spark.createDataFrame([("a.py", 9), ("d.py", 4)], "file string, churn long")
    assert rows(st.warns_and_churn(warns, churn)) == [("a.py", 2, 0, 9), ("b.py", 0, 1, 0), ("c.py", 0, 0, 0), ("d.py", 0, 0, 4)]
    texts = spark.createDataFrame([("dup.block", "why")], "analyzer_id string, rationale string")
    assert sorted(r["rationale"] for r in with_rationale(found, texts).collect()) == ["", "", "", "why", "why", "why"]
    t = datetime.datetime(2024, 1, 10, 12)
    at = spark.createDataFrame([("r", f, t) for f in ("old.py", "late.py", "none.py")], "repo string, file string, at timestamp")
    first = spark.createDataFrame([("r", "old.py", t - datetime.timedelta(days=3, seconds=-1)), ("r", "late.py", t + datetime.timedelta(days=1)), ("q", "none.py", t)], "repo string, file string, first timestamp")
    assert rows(st.file_age(at, first).select("file", "age_days")) == [("late.py", 0), ("none.py", None), ("old.py", 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "l.csv").write_text('repo,file,label,note\nr,a.py,tp,"x, ""y"""\nr,b.py, ,\n')
    assert rows(history.labelled(spark, str(tmp_path / "l.csv")).select("file", "label", "note")) == [("a.py", "tp", 'x, "y"'), ("b.py", None, None)]
    (tmp_path / "hits.json").write_text('[{"filename": "a.py", "code": "S110", "location": {"row": 3, "column": 1}}, {"code": "E", "location": null}]')
    assert rows(history.linter_hits(spark, str(tmp_path / "hits.json"))) == [("a.py", 3, "S110")]
    log = ["@2024-01-03T00:00:00+00:00", "a.py", "b.md", "@bad", "x.py", "@2024-01-02T00:00:00+00:00", "a.py"]
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(log)], "repo string, n int, value string")
    assert [(r["file"], str(r["t"])) for r in history.first_commits(lines).where("file = 'a.py'").selectExpr("file", "cast(first AS date) AS t").collect()] == [("a.py", "2024-01-02")]


def test_reports(spark):
    found = spark.createDataFrame([("a.py", 3), ("a.py", 9), ("b.py", 1)], "file string, line int")
    hits = spark.createDataFrame([("a.py", 5), ("a.py", 6)], "path string, row int")
    assert rows(st.overlap_totals(st.band_overlap(found, hits))) == [(3, 2, 1, 66.7, 33.3)]
    assert rows(st.overlap_totals(st.band_overlap(found.limit(0), hits))) == [(0, 0, 0, 0.0, 0.0)]
    labels = [("r", "k", x) for x in ["tp"] * 2 + ["fp"] * 3] + [("q", "k", x) for x in ["tp"] + ["fp"] * 3] + [("p", "k", "boilerplate")]
    gates = {(r["repo"], r["kind"]): r["gate"] for r in st.label_scores(spark.createDataFrame(labels, "repo string, kind string, label string")).collect()}
    assert (gates[("r", None)], gates[("q", None)], gates[("p", None)]) == ("pass", "threshold", "redesign")
    obs = spark.createDataFrame([(1, 2, 0, 0), (3, 0, 1, 5)], "loc int, warns_dup int, warns_em int, churn_14d int")
    assert [round(r["log_churn_14d"], 6) for r in st.touched(obs).collect()] == [1.791759]
