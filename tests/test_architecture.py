"""The import graph: names, edges, components and layers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from treewarden.operators.analyzers import REGISTRY
from treewarden.operators.architecture import CYCLE, MOST_EDGES, components, import_edges, layered, layers
from treewarden.operators.nodes import node_table


def _tree(spark, sources):
    return spark.createDataFrame([(r, p, t, bytearray(t.encode())) for (r, p), t in sources.items()], "repo string, path string, text string, content binary")


def test_edges(spark):
    files = {
        "src/pkg/__init__.py": "from .a import *\nfrom . import gone\nimport pkg\n",
        "src/pkg/a.py": "import os, pkg.sub.b, pkg.sub.missing.c\nfrom ..beyond import x\nfrom ... import y\n",
        "src/pkg/sub/__init__.py": "from ..a import f\nfrom . import b as c\n",
        "src/pkg/sub/b.py": "def late():\n    from .. import a\n    from pkg import a as again\nfrom __future__ import annotations\n",
        # a package goes before a module of its name, and another tree's modules are none of ours
        "twice.py": "",
        "twice/__init__.py": "",
        "user.py": "import twice\nfrom twice import name\n",
        "broken.py": "import twice(\n",
        "points.py": "import broken\n",
    }
    nodes = node_table(_tree(spark, {("r", p): t for p, t in files.items()} | {("other", "uses.py"): "import pkg.a\n"}))
    got = {(r["repo"], r["path"], r["target"], r["line"]) for r in import_edges(nodes).collect()}
    assert got == {
        ("r", "src/pkg/__init__.py", "src/pkg/a.py", 1),
        ("r", "src/pkg/a.py", "src/pkg/sub/b.py", 1),
        ("r", "src/pkg/a.py", "src/pkg/sub/__init__.py", 1),
        ("r", "src/pkg/sub/__init__.py", "src/pkg/a.py", 1),
        ("r", "src/pkg/sub/__init__.py", "src/pkg/sub/b.py", 2),
        ("r", "src/pkg/sub/b.py", "src/pkg/a.py", 2),
        ("r", "user.py", "twice/__init__.py", 1),
        ("r", "points.py", "broken.py", 1),
    }


def _reaches(edges):
    """Where each file leads to over one edge or more."""
    out = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        more = {a: to.union(*(out.get(b, ()) for b in to)) for a, to in out.items()}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("most", [MOST_EDGES, 6])
def test_components_and_layers(spark, most):
    """Graphs of several trees in one table, with hubs, repeated edges and loops: each tree in one task, and those of more than six edges in rounds."""
    rng = random.Random(7)
    edges = set()
    for repo, n, m in (("dense", 9, 14), ("sparse", 20, 22), ("line", 5, 0), ("rings", 0, 0)):
        edges |= {(repo, f"{rng.randrange(n):02d}", f"{rng.randrange(n):02d}") for _ in range(m)}
        if repo == "line":
            edges |= {(repo, f"{i}", f"{i - 1}") for i in range(1, n)} | {(repo, "4", "4")}
        if repo == "rings":
            edges |= {(repo, f"{i}", f"{i // 3 * 3 + (i + 1) % 3}") for i in range(6)} | {(repo, "2", "3"), (repo, "5", "x"), (repo, "w", "0")}
        if repo == "sparse":
            edges |= {(repo, f"{i:02d}", "00") for i in range(n)}
    names = {(r, x) for r, *ends in edges for x in ends} | {("empty", "alone")}
    table = spark.createDataFrame([(*e, 1) for e in sorted(edges)] * 2, "repo string, path string, target string, line int")
    found = components(table, most)
    got = {(r["repo"], r["path"]): r["component"] for r in found.collect()}
    want, layer = {}, {}
    for repo in {r for r, _ in names}:
        own = {(a, b) for r, a, b in edges if r == repo and a != b}
        reach = _reaches(own)
        for a in {n for r, n in names if r == repo}:
            members = {b for b in reach.get(a, ()) if a in reach.get(b, ())}
            if members - {a}:
                want[repo, a] = min(members | {a})
        of = lambda a: want.get((repo, a), a)  # noqa: B023, E731
        between = {(of(a), of(b)) for a, b in own if of(a) != of(b)}

        def height(a):
            return max((1 + height(b) for x, b in between if x == a), default=0)  # noqa: B023

        layer |= {(repo, a): height(of(a)) for r, a in names if r == repo}
    assert got == want and len(set(want.values())) > 1
    files = spark.createDataFrame(sorted(names), "repo string, path string")
    assert {(r["repo"], r["path"]): r["layer"] for r in layers(files, table, found, most).collect()} == layer


def test_findings(spark):
    sources = {("r", "core/a.py"): "import os\nimport app.b\n", ("r", "app/b.py"): "import core.a\nimport core.own\n", ("r", "core/own.py"): "", ("r", "app/core/c.py"): "import app.b\n", ("r", "free.py"): "import app.b\n"}
    files = _tree(spark, sources)
    nodes = node_table(files)
    found = CYCLE.run(nodes, files).orderBy("file").collect()
    assert [(r["file"], r["start_line"], r["severity"]) for r in found] == [("app/b.py", 1, "warn"), ("core/a.py", 2, "warn")]
    assert found[1]["evidence"] == '{"target":"app/b.py","component":"app/b.py","size":2}'
    up = layered([("core", ["core", "app/core/"]), ("app", ["app"])]).run(nodes, files).orderBy("file").collect()
    assert [(r["file"], r["start_line"], r["message"]) for r in up] == [("app/core/c.py", 1, "`core` imports `app/b.py` of `app` above it"), ("core/a.py", 2, "`core` imports `app/b.py` of `app` above it")]
    assert "arch.cycle" not in REGISTRY
    none = _tree(spark, {("r", "a.py"): "x = 1\n"}).where(F.lit(False))
    assert CYCLE.run(node_table(none), none).count() == 0


def test_no_side_goes_through_the_driver(spark):
    """Joins of what grows with a tree are merges, however small the tables are here."""
    from treewarden.operators.architecture import components, cycle_imports, import_edges, layers
    from treewarden.operators.nodes import node_table

    sources = {"src/a.py": "import b\n", "src/b.py": "import a\nimport c\n", "src/c.py": ""}
    nodes = node_table(spark.createDataFrame([("r", p, bytearray(t.encode())) for p, t in sources.items()], "repo string, path string, content binary"))
    edges = import_edges(nodes)
    found = components(edges)
    for df in (edges, found, cycle_imports(edges), layers(nodes.where("id = 0"), edges, found)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
