"""Versions kept up by touched keys, against a cold scan; damage, compaction and expiry."""

import random

from pyspark.sql import functions as F

from treewarden.operators.analyzers import REGISTRY
from treewarden.streaming.state import Incremental

LISTED = "repo string, path string, mtime double"
READ = "repo string, path string, text string, content binary, error string"
BODY = "def f{}():\n" + "".join(f"    step{i}()\n" for i in range(6))


def tree(spark, files):
    """(listed, read) of {path: (time, text)}."""
    listed = spark.createDataFrame([("r", p, float(t)) for p, (t, _) in files.items()], LISTED)
    return listed, spark.createDataFrame([("r", p, x, bytearray(x.encode()), None) for p, (_, x) in files.items()], READ)


def scan(state, monkeypatch, files):
    from treewarden.sources import files as f

    listed, read = tree(state.spark, files)
    monkeypatch.setattr(f, "with_content", lambda rows: read.join(rows.select("repo", "path"), ["repo", "path"], "left_semi"))
    return state.scan(listed)


def ids(state, version=None):
    return sorted((r["id"], r["file"], r["start_line"], r["message"]) for r in state.findings(version).collect())


def text(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return BODY.format(rng.randrange(3)) + ("    extra()\n" * rng.randrange(3))
    if kind == 1:
        return f"def load{rng.randrange(3)}():\n    return 1\ndef save():\n    return 2\n"
    if kind == 2:
        return f"def test_load{rng.randrange(3)}_x(mocker):\n    mocker.patch('m.load{rng.randrange(3)}')\n    assert save()\n"
    if kind == 3:
        return "def f(x=[]): pass\n" * rng.randrange(3)
    return "def broken(:\n"


NAMES = ["a/m.py", "b/m.py", "tests/test_m.py", "a/test_m.py", "n.py", "tests/test_n.py", "o.py", "p.py", "q.py"]


def test_random_edits(spark, tmp_path, monkeypatch, seed=1):
    rng = random.Random(seed)
    state, files = Incremental(spark, str(tmp_path / "s"), buckets=4), {}
    for step in range(3):
        for name in rng.sample(NAMES, 6 if step == 0 else rng.randint(1, 3)):
            if name in files and rng.random() < 0.3:
                del files[name]
            else:
                files[name] = (step, text(rng))
        now = scan(state, monkeypatch, files)
        assert (now["mode"], set(now["base"])) == ("warm" if step else "cold", {n for n, a in REGISTRY.items() if a.keyed})
        assert not state.errors().where("path IS NULL OR kind = 'SyntaxError' AND message IS NULL").count()
    cold = Incremental(spark, str(tmp_path / "c"))
    scan(cold, monkeypatch, files)
    assert ids(state) == ids(cold)


def test_an_edit_reads_what_it_touches(spark, tmp_path, monkeypatch):
    """Of many modules with tests and bodies of their own, an edit of one judges its keys alone."""
    files = {}
    for i in range(100):
        files[f"m{i}.py"] = (0, f"def load{i}():\n" + "".join(f"    own{i}_{k}()\n" for k in range(6)))
        files[f"tests/test_m{i}.py"] = (0, f"def test_a():\n    assert other{i}()\n")
    files["twin.py"] = (0, BODY.format(1))
    files["other.py"] = (0, BODY.format(2))
    state = Incremental(spark, str(tmp_path / "s"))
    scan(state, monkeypatch, files)
    before = ids(state)
    files["m7.py"] = (1, files["m7.py"][1] + BODY.format(3))
    now = scan(state, monkeypatch, files)
    assert (now["reindexed"], now["judged"] < 40, now["touched"] < 20) == (1, True, True)
    judged = {f: v["dup.block"] for f, v in state.manifest(2).select("path", "judged").collect()}
    assert {f for f, v in judged.items() if v == 2} == {"m7.py", "twin.py", "other.py"}
    cold = Incremental(spark, str(tmp_path / "c"))
    scan(cold, monkeypatch, files)
    assert ids(state) == ids(cold) != before and ids(state, 1) == before
    facts = state.facts_of("dup.block", REGISTRY["dup.block"].keyed.facts(*_nothing(spark)).schema, 1, spark.createDataFrame([("r", 5)], "repo string, key long"), [3], state.manifest(2))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan and "= 3" in plan


def _nothing(spark):
    from treewarden.operators.nodes import SCHEMA

    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "repo string, path string, text string, content binary")


def test_damage_is_mended_by_one_cold_scan(spark, tmp_path, monkeypatch):
    files = {"m.py": (0, "def f(x=[]): pass\n"), "twin.py": (0, BODY.format(1))}
    state = Incremental(spark, str(tmp_path / "s"))
    for step in range(2):
        files["m.py"] = (step, f"def f(x{step}=[]): pass\n")
        scan(state, monkeypatch, files)
    good = ids(state, 1)

    def spoil(folder):
        for p in folder.rglob("*.parquet"):
            p.write_bytes(b"{not parquet")
        for p in folder.rglob(".*.crc"):
            p.unlink()

    spoil(tmp_path / "s/manifest/version=2")
    assert state.load() is None
    assert [(x["version"], x["mode"]) for x in (scan(state, monkeypatch, files), scan(state, monkeypatch, files))] == [(3, "cold"), (4, "warm")]
    assert state.load()["version"] == 4 and ids(state, 1) == good and [f[1] for f in ids(state)] == ["m.py"]
    spoil(tmp_path / "s/facts-dup.block/version=3")  # found on the way
    files["twin2.py"] = (9, BODY.format(2))
    assert scan(state, monkeypatch, files)["mode"] == "cold" and sorted(f[1] for f in ids(state)) == ["m.py", "twin.py", "twin2.py"]


def test_compaction_expiry_and_pins(spark, tmp_path, monkeypatch):
    files = {f"m{i}.py": (0, f"def f(x{i}=[]): pass\n") for i in range(4)} | {"twin.py": (0, BODY.format(1)), "twin2.py": (0, BODY.format(2))}
    state = Incremental(spark, str(tmp_path / "s"), keep=1, compact_beyond=2, buckets=2)
    seen = {}
    for step in range(4):
        files[f"m{step % 4}.py"] = (step, f"def f(y{step}=[]): pass\n")
        version = scan(state, monkeypatch, files)["version"]
        seen[version] = ids(state, version)
        if step == 0:
            state.pin(version)
    stay = state._versions("state")
    assert 1 in stay and len(stay) <= 3 and len(state._versions("nodes")) <= 4 and len(state.load()["needs"]) <= 2
    assert ids(state, 1) == seen[1] and ids(state) == seen[max(seen)] and 4 not in seen  # the third scan was compacted into version 4
    state.unpin(1)
    assert 1 not in state.expire() and 1 not in state._versions("state") and len(state._versions("facts-dup.block")) <= 2
    cold = Incremental(spark, str(tmp_path / "c"))
    scan(cold, monkeypatch, files)
    assert ids(state) == ids(cold)


def test_no_side_goes_through_the_driver(spark, tmp_path):
    """Joins of what grows with the trees are merges in every job of a cold and a warm version, however small the tables are here."""
    files = {"m.py": (0, "def load():\n    try:\n        go()\n    except:\n        pass\n"), "tests/test_m.py": (0, "def test_load(mocker):\n    mocker.patch('m.load')\n    assert True\n"), "twin.py": (0, BODY.format(1)), "twin2.py": (0, BODY.format(2))}
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    state, version = Incremental(spark, str(tmp_path / "s")), None
    for status in ("added", "modified"):
        present, read = tree(spark, files)
        changes = present.where(f"'{status}' = 'added' OR path = 'twin2.py'").select("repo", "path", F.lit(status).alias("status"))
        version = state.apply(read.where(f"'{status}' = 'added' OR path = 'twin2.py'"), changes, present, version)
        files["twin2.py"] = (1, BODY.format(3))
    assert len(ids(state)) >= 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    plans = [x.physicalPlanDescription() for x in ran if x.executionId() not in before]
    assert sum("SortMergeJoin" in x for x in plans) > 20 and not [x[:2000] for x in plans if "BroadcastExchange" in x]
