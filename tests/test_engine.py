import hashlib
import io
import json
import subprocess

import pytest

from treewarden.functions.identity import finding_id
from treewarden.plans.check import main
from treewarden.sources import baseline
from treewarden.sources.files import ListingCache, commit_of, git_changes, listing, repo_list
from treewarden.streaming.changes import emit_lines, follow, watch
from treewarden.streaming.state import Incremental


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)


def test_refs_and_changes(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    assert len({commit_of(tmp_path, r) for r in ("HEAD", "HEAD~0", "HEAD^0", "@")}) == 1
    for bad in ("", "-x", "--all", "a..b", "HEAD..HEAD", "a b", "a;b", "absent"):
        with pytest.raises(ValueError, match="no commit"):
            commit_of(tmp_path, bad)
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "b.py").unlink()
    assert [(r["path"], r["status"]) for r in git_changes(spark, tmp_path).orderBy("path").collect()] == [("a.py", "modified"), ("b.py", "deleted")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        git_changes(spark, "/")
    (tmp_path / "repos.txt").write_text("# all\nhttps://x/y/one.git main\n\nhttps://x/two  # second\n")
    assert [tuple(r) for r in repo_list(spark, str(tmp_path / "repos.txt")).collect()] == [("one", "https://x/y/one.git", "main"), ("two", "https://x/two", None)]


def test_listing_cache(tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", ".")
    cache = ListingCache()
    assert [r[1] for r in cache.listing(tmp_path)] == ["a.py"]
    (tmp_path / "b.py").write_text("x = 1\n")
    assert [r[1] for r in cache.listing(tmp_path)] == ["a.py"]
    git(tmp_path, "add", ".")
    assert [r[1] for r in cache.listing(tmp_path)] == ["a.py", "b.py"]
    (tmp_path / "c.py").write_text("x = 1\n")
    cache.reset()
    assert len(cache.listing(tmp_path)) == 3


def test_listing(tmp_path):
    for p in ("a.py", "sub/__init__.py", "node_modules/junk.py", "readme.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    assert [r[1] for r in listing(tmp_path)] == ["a.py", "sub/__init__.py"]


def test_ids_follow_the_subject():
    text = '{"a": "arg.mutable-default", "e": {"kind": "list-literal", "param": "x", "snippet": "[]"}, "s": "x", "v": "1"}'
    assert finding_id("arg.mutable-default", "1", "x", {"snippet": "[]", "kind": "list-literal", "param": "x"}) == hashlib.blake2b(text.encode(), digest_size=12).hexdigest()
    assert finding_id("a", "1", "f.py", {"k": 1}) == finding_id("a", "1", "f.py", {"k": 1}) != finding_id("a", "1", "g.py", {"k": 1})


def test_check_baseline_diff(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.py").write_text("def f(x=[]):\n    return x\n")
    assert main(["check", str(repo), "--exit-code"]) == 1
    main(["check", str(repo), "--json"])
    text = capsys.readouterr().out
    base = json.loads(text[text.index("{") :])
    assert [f["symbol"] for f in base["findings"]] == ["x"] and base["summary"]["warn"] == 1
    main(["baseline", str(repo)])
    (repo / "a.py").write_text("\n\ndef f(x=[]):\n    return x\ndef g(y={}):\n    return y\n")
    capsys.readouterr()
    main(["check", str(repo), "--json", "--baseline"])
    assert [f["symbol"] for f in json.loads(capsys.readouterr().out)["findings"]] == ["y"]
    main(["check", str(repo), "--json"])
    (tmp_path / "base.json").write_text(json.dumps(base))
    (tmp_path / "head.json").write_text(capsys.readouterr().out)
    main(["diff", str(tmp_path / "base.json"), str(tmp_path / "head.json")])
    told = json.loads(capsys.readouterr().out)
    assert told["schema"] == 1 and told["base"]["repo"] == base["repo"] and told["summary"] == {"added": {"block": 0, "warn": 1, "info": 0}, "resolved": {"block": 0, "warn": 0, "info": 0}, "moved": {"block": 0, "warn": 1, "info": 0}, "stable": 0}
    moved = told["changes"]["moved"][0]
    assert (moved["symbol"], moved["from"]["span"], moved["to"]["span"], moved["to"]["file"]) == ("x", [1, 1], [3, 3], "a.py") and told["changes"]["added"][0]["symbol"] == "y"
    main(["diff", str(tmp_path / "base.json"), str(tmp_path / "head.json"), "--markdown"])
    lines = capsys.readouterr().out.strip().split("\n")
    assert [x.split(" | ")[:2] for x in lines[2:]] == [["| **added**", "1"], ["|  ", "warn"], ["| **moved**", "1"], ["|  ", "warn"]] and "a.py:3, before a.py:1" in lines[-1]
    main(["diff", str(tmp_path / "base.json"), str(tmp_path / "base.json"), "--markdown"])
    assert capsys.readouterr().out.strip() == ""
    main(["check", str(repo)])
    assert "  warn   a.py:3  [arg.mutable-default]" in capsys.readouterr().out
    main(["report", str(repo), "--out", str(tmp_path / "page.html")])
    assert "<select id=s" in (tmp_path / "page.html").read_text()
    assert main(["check", str(repo / "absent")]) == 2
    (tmp_path / "bad.json").write_text("{not json")
    assert baseline.load(spark, tmp_path / "bad.json") is None


def test_unreadable_files_are_named(spark, tmp_path, capsys, monkeypatch):
    """A file that goes between listing and reading is named and counted, and the check fails."""
    from treewarden.functions.scratch import written
    from treewarden.plans import check
    from treewarden.sources.files import full_scan

    (tmp_path / "a.py").write_text("def f(x=[]):\n    return x\n")
    (tmp_path / "b.py").write_text("def g(y=[]):\n    return y\n")

    def scan(spark, repos):
        found = written(full_scan(spark, repos), "listing")
        (tmp_path / "b.py").unlink(missing_ok=True)
        return found

    monkeypatch.setattr(check, "full_scan", scan)
    assert main(["check", str(tmp_path), "--json"]) == 2
    said = capsys.readouterr()
    data = json.loads(said.out[said.out.index("{") :])
    assert (data["summary"]["files_scanned"], data["summary"]["files_unreadable"], [f["symbol"] for f in data["findings"]]) == (1, 1, ["x"])
    assert "error: b.py: FileNotFoundError" in said.err
    monkeypatch.undo()
    assert main(["check", str(tmp_path), "--json"]) == 0
    with pytest.raises(FileNotFoundError):
        listing(tmp_path / "absent")


def test_parse_errors_are_told(tmp_path, capsys):
    (tmp_path / "bad.py").write_text("def f(:\n")
    (tmp_path / "fine.py").write_text("def f(x=[]):\n    return f\"it's {x}\"\n")
    assert main(["check", str(tmp_path), "--json"]) == 0
    said = capsys.readouterr()
    data = json.loads(said.out[said.out.index("{") :])
    assert [f["symbol"] for f in data["findings"]] == ["x"] and (data["summary"]["files_unparsed"], data["errors_total"], data["errors"][0]["path"]) == (1, 1, "bad.py") and "error: bad.py" in said.err


def put(repo, sources):
    repo.mkdir(exist_ok=True)
    for p in repo.glob("*.py"):
        if p.name not in sources:
            p.unlink()
    for name, text in sources.items():
        if not (repo / name).exists() or (repo / name).read_text() != text:
            (repo / name).write_text(text)


ONE = {"w.py": "def a(): pass\ndef b(): pass\n", "test_w.py": "a()\n", "m.py": "def f(x=[]): pass\n", "bad.py": "def f(:\n"}
TWO = {"w.py": ONE["w.py"], "test_w.py": "a(); b()\n", "n.py": "def g(x={}): pass\n", "bad.py": ONE["bad.py"]}


def test_incremental_equals_full(spark, tmp_path):
    from treewarden.sources.files import full_scan

    repo = tmp_path / "repo"
    put(repo, ONE)
    state = Incremental(spark, str(tmp_path / "state"))
    assert state.load() is None
    cold = state.scan(full_scan(spark, [repo]))
    assert (cold["version"], cold["mode"], cold["reindexed"], cold["removed"]) == (1, "cold", 4, 0) and [r["path"] for r in state.errors().collect()] == ["bad.py"]
    again = state.scan(full_scan(spark, [repo]))
    assert (again["mode"], again["reindexed"], again["new"], again["gone"]) == ("warm", 0, 0, 0)
    put(repo, TWO)
    warm = state.scan(full_scan(spark, [repo]))
    assert (warm["version"], warm["reindexed"], warm["removed"], warm["new"], warm["gone"]) == (3, 2, 1, 1, 2)
    fresh = Incremental(spark, str(tmp_path / "cold"))
    fresh.scan(full_scan(spark, [repo]))
    assert sorted(r["id"] for r in state.findings().collect()) == sorted(r["id"] for r in fresh.findings().collect()) != []
    assert [r["version"] for r in state.feed(2).collect()] == [3, 2] and [r["path"] for r in state.errors().collect()] == ["bad.py"]


def test_states_that_are_refused(spark, tmp_path, monkeypatch):
    from treewarden.sources.files import full_scan
    from treewarden.streaming import state as states

    repo = tmp_path / "repo"
    put(repo, {"m.py": "def f(x=[]): pass\n"})
    state = Incremental(spark, str(tmp_path / "state"))
    state.scan(full_scan(spark, [repo]))
    assert Incremental(spark, str(tmp_path / "state")).load()["version"] == 1
    with monkeypatch.context() as m:
        m.setattr(states, "__version__", "another")
        assert state.load() is None
    for p in (tmp_path / "state" / "manifest").rglob("*.parquet"):
        p.write_bytes(b"{not parquet")
    for p in (tmp_path / "state" / "manifest").rglob(".*.crc"):
        p.unlink()
    assert state.load() is None


def test_analyzers_are_apart(spark, tmp_path):
    from treewarden.operators import analyzers
    from treewarden.sources.files import full_scan

    repo = tmp_path / "repo"
    put(repo, {"m.py": "def f(x=[]): pass\n", "w.py": "def a(): pass\n", "test_w.py": "x\n"})
    state = Incremental(spark, str(tmp_path / "state"))
    state.scan(full_scan(spark, [repo]))

    @analyzers.register("own.broken", "1")
    def broken(nodes, files):
        raise RuntimeError("no")

    kept = analyzers.REGISTRY["test.no-test-for-public-symbol"]
    analyzers.REGISTRY["test.no-test-for-public-symbol"] = analyzers.Analyzer(kept.id, kept.version, True, broken)
    try:
        put(repo, {"m.py": "def f(y=[]): pass\n", "w.py": "def a(): pass\n", "test_w.py": "x\n"})
        state.scan(full_scan(spark, [repo]))
        assert {r["path"] for r in state.errors().collect()} == {"own.broken", "test.no-test-for-public-symbol"}
        assert sorted(r["symbol"] for r in state.findings().collect()) == ["a", "y"]  # the failed one's old findings stay
    finally:
        del analyzers.REGISTRY["own.broken"]
        analyzers.REGISTRY["test.no-test-for-public-symbol"] = kept


def test_follow(spark, tmp_path):
    """Events drive versions; a scan that fails is told and the next event catches up; --once ends; a line a version."""
    from treewarden.sources.files import full_scan
    from treewarden.sources.watching import TreeSource

    repo = tmp_path / "repo"
    put(repo, {"m.py": "def f(x=[]): pass\n", ".#m.py": "junk(\n"})
    spark.dataSource.register(TreeSource)
    changes = spark.readStream.format("tree").option("repo", str(repo)).option("snapshots", str(tmp_path / "snaps")).load()
    state, out, failing = Incremental(spark, str(tmp_path / "state")), io.StringIO(), []

    def listed():
        if failing:
            raise OSError(failing.pop())
        return full_scan(spark, [repo])

    def go():
        follow(changes, state, listed, str(tmp_path / "ck"), emit_lines(out, state), once=True).awaitTermination()
        return [json.loads(x) for x in out.getvalue().splitlines()]

    assert [(x["version"], [f["symbol"] for f in x["findings"]]) for x in go()] == [(1, ["x"])] and state.errors().isEmpty()
    failing.append("gone")
    put(repo, {"m.py": "def f(yy=[]): pass\n", ".#m.py": "junk(\n"})
    assert "gone" in go()[-1]["error"]
    put(repo, {"m.py": "def f(yy=[]): pass\n", "n.py": "def g(z=[]): pass\n", ".#m.py": "junk(\n"})
    last = go()[-1]
    assert sorted(f["symbol"] for f in last["findings"]) == ["yy", "z"] and (last["version"], last["reindexed"]) == (2, 2)


def test_watch(spark, tmp_path):
    from treewarden.sources.watching import TreeSource

    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "__init__.py").write_text("x = 1\n")
    spark.dataSource.register(TreeSource)
    seen = []
    query = watch(spark.readStream.format("tree").option("repo", str(repo)).load(), str(tmp_path / "ck"), lambda df, v: seen.extend((r["path"], r["status"]) for r in df.collect()), every="100 milliseconds")
    try:
        query.processAllAvailable()
        assert seen == [("__init__.py", "added")]
    finally:
        query.stop()
