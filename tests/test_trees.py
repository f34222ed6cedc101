"""The data source of trees: filters decide which files are opened."""

import json

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

from treewarden.functions.paths import is_non_source, is_test
from treewarden.plans.check import check, main
from treewarden.sources.files import listing
from treewarden.sources.trees import Trees, classes, read_trees, written_pushing

PATHS = ["a.py", "test_a.py", "a_test.py", "tests/x.py", "data/test_b.py", "x/fixtures/c_test.py", "docs/d.py", "test_dir/e.py", "doc/test_f.py", "g/testing", "tests.py", "test_.py", "_test.py"]


def tree(tmp_path):
    for p in (x for x in PATHS if x.endswith(".py")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"def test_it(): {p!r}\n" + "#" * (len(p) * 10))
    return tmp_path


def test_classes_are_those_of_columns(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", is_test(F.col("path")), is_non_source(F.col("path")))
    assert {p: classes(p) for p in PATHS} == {p: (a, b) for p, a, b in df.collect()}


def test_what_is_pushed(tmp_path):
    repo = str(tree(tmp_path))
    reader = Trees({"repos": json.dumps([repo]), "most_bytes": "300", "push": "true"}).reader(None)
    left = list(reader.pushFilters([EqualTo(("test",), True), Not(StringStartsWith(("path",), "doc/")), GreaterThan(("length",), 5), In(("repo",), ("x", str(tmp_path.resolve()))), IsNull(("error",)), EqualTo(("error",), "x")]))
    assert left == [IsNull(("error",)), EqualTo(("error",), "x")]
    parts = reader.partitions()
    rows = [r for p in parts for r in p.rows]
    assert sorted(r[1] for r in rows) == sorted(p for p in PATHS if classes(p)[0] and not p.startswith("doc/"))
    assert len(parts) > 1 and all(len(p.rows) == 1 or sum(r[4] for r in p.rows) <= 300 for p in parts)
    assert sorted(r for b in parts for batch in reader.read(b) for r in batch.column("path").to_pylist()) == sorted(r[1] for r in rows)


def test_only_tests_are_opened(spark, tmp_path):
    """A file that isn't a test can't be read, which nobody notices who asks for tests."""
    repo = tree(tmp_path)
    every = read_trees(spark, [repo])
    assert sorted(r["path"] for r in every.select("path").collect()) == sorted(r[1] for r in listing(repo))
    assert [r["content"] for r in every.where("path = 'a.py'").collect()] == [(repo / "a.py").read_bytes()]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    tests = written_pushing(read_trees(spark, [repo], push=True).where("test"), "files")
    assert sorted(r["path"] for r in tests.collect()) == sorted(p for p in PATHS if classes(p)[0]) and spark.conf.get("spark.sql.python.filterPushdown.enabled") == before
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        plan = read_trees(spark, [repo], push=True).where("test AND error IS NULL")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert "isnull(error" in plan and "Filter test" not in plan and "Filter (test" not in plan, plan


def test_check_of_some_analyzers(spark, tmp_path, capsys):
    repo = tree(tmp_path)
    found, files, errors = check(spark, [str(repo)], ["test.assertion-free", "test.time.sleep"])
    assert sorted({r["file"] for r in found.collect()}) == sorted(r["path"] for r in files.collect()) == sorted(p for p in PATHS if classes(p)[0]) and errors.isEmpty()
    assert main(["check", str(repo), "--json", "--only", "arg.mutable-default"]) == 0
    said = capsys.readouterr().out
    assert json.loads(said[said.index("{") :])["summary"]["files_scanned"] == len(listing(repo))
