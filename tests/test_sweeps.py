"""Subtrees by open owners, string shares by one sweep, greedy choice in one pass: work that grows with a file, not with its square."""

import random

from pyspark.sql import functions as F

from treewarden.operators import analyzers as an
from treewarden.operators.nodes import SCHEMA, file_nodes, node_table


def test_one_pair_for_each_owner(spark):
    """Thousands of tests one after another, and some within others: a call meets the tests around it and no other."""
    text = "".join(f"def test_{i}():\n    go()\n" for i in range(3000)) + "def test_a():\n    def test_b():\n        def helper():\n            assert go()\n    other()\n"
    files = spark.createDataFrame([("r", "test_m.py", text, bytearray(text.encode()))], "repo string, path string, text string, content binary")
    nodes = node_table(files)
    calls = nodes.where("type = 'call'").select("repo", "path", "id", "owners")
    pairs = an._inside(an._tests(nodes), calls, "fn")
    assert pairs.count() == 3000 + 2 + 1
    free = {r["symbol"] for r in an.REGISTRY["test.assertion-free"].run(nodes, files).collect()}
    assert len(free) == 3000 and not {"test_a", "test_b"} & free
    assert "_path" not in pairs._jdf.queryExecution().executedPlan().toString()  # keys alone, no range beside them


def test_owners_close_with_their_subtree():
    rows = file_nodes(b"def test_a():\n    try:\n        a()\n    except E as e:\n        raise e\n    b()\n@d(c())\ndef test_b():\n    f()\ndef g():\n    h()\n")
    named = {r["id"]: r["text"] if r["type"] == "function_definition" else r["type"] for r in rows}
    owners = {r["source"]: [named[i] for i in r["owners"]] for r in rows if r["type"] in ("call", "raise_statement")}
    assert owners == {"a()": ["test_a"], "raise e": ["test_a", "except_clause"], "b()": ["test_a"], "d(c())": [], "c()": [], "f()": ["test_b"], "h()": []}


def test_bytes_of_literals_before_a_place(spark):
    """Against counting byte by byte each literal that covers a byte, literals within literals and touching ones included."""
    rng = random.Random(7)
    spans = {f"f{k}": [(a, a + rng.randint(1, 9)) for a in rng.sample(range(200), rng.randint(0, 40))] for k in range(6)}
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [tuple({"repo": "r", "path": f, "type": "string", "start_byte": a, "end_byte": b}.get(c) for c in columns) for f, s in spans.items() for a, b in s]
    places = [("r", f, p) for f in spans for p in rng.sample(range(230), 50)]
    got = an._filled_to(spark.createDataFrame(places, "repo string, path string, at long"), an._merged_strings(spark.createDataFrame(rows, SCHEMA)), "at")
    assert {(r["path"], r["at"]): r["filled"] for r in got.collect()} == {(f, p): sum(max(0, min(b, p) - a) for a, b in spans[f]) for _, f, p in places}


def test_greedy_choice_of_many_starts(spark):
    """A file of 100,000 overlapping windows and small ones beside it, dealt over tasks and batches."""
    rng = random.Random(8)
    starts = {"big": range(1, 100_001), **{f"s{i}": sorted(rng.sample(range(60), 20)) for i in range(20)}}
    rows = [("r", f, s, f"w{s % 3}") for f, all_of in starts.items() for s in all_of] + [("r", "s0", s, "v") for s in starts["s0"]]
    got = an.collapse(spark.createDataFrame(rows, "repo string, path string, start_line int, win_text string").repartition(8))
    kept = {}
    for f, all_of in starts.items():
        last = 0
        for s in all_of:
            if s > last or (s == 0 and not kept.get(f)):
                kept.setdefault(f, []).append(s)
                last = s + an.WINDOW - 1
    found = got.groupBy("path").agg(F.sort_array(F.collect_list("start_line")).alias("s")).collect()
    assert {r["path"]: r["s"] for r in found} == kept
    assert {r["win_text"] for r in got.where("path = 's0'").collect()} == {"v"}
