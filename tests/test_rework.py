"""Lines followed through commits, against git blame and against lists of lines."""

import os
import random
import subprocess
from collections import Counter

from treewarden.analytics.rework import line_moves, rework, rework_share
from treewarden.sources.hunks import SCHEMA, hunks, parsed_hunks

DAY = 86_400_000_000


def test_against_blame(spark, tmp_path):
    """Random edits with renames, deletions, names to be quoted, a merge and lines that look like headers."""
    rng = random.Random(3)
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b"]
    n = iter(range(10_000))
    fresh = lambda: rng.choice(["{}", "-- a/{}", "++ b/{}", "@@ -1 +1 @@ {}", "commit {}"]).format(next(n))
    files = {"one.py": [fresh() for _ in range(12)], "zwei \"ü\".py": [fresh() for _ in range(12)], "sub/c.py": [fresh()]}

    def commit(day):
        for name, lines in files.items():
            (tmp_path / name).parent.mkdir(exist_ok=True)
            # every other file has no newline at its end
            (tmp_path / name).write_text("\n".join(lines) + ("\n" if len(lines) % 2 else ""))
        subprocess.run([*git, "add", "-A"], check=True)
        when = f"2024-01-{day:02d}T00:00:00+00:00"
        subprocess.run([*git, "commit", "-qm", "x", "--allow-empty"], check=True, env=os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})

    subprocess.run([*git, "init", "-q", "-b", "main"], check=True)
    commit(1)
    for day in range(2, 22):
        for lines in files.values():
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(lines) + 1)
                lines[at : at + rng.randrange(3)] = [fresh() for _ in range(rng.randrange(3))]
            lines.append(fresh())
        if day == 8:
            os.remove(tmp_path / "one.py")
            files["moved.py"] = files.pop("one.py")
        if day == 12:
            os.remove(tmp_path / "sub/c.py")
            del files["sub/c.py"]
        if day == 15:
            files["sub/c.py"] = [fresh(), fresh()]
            subprocess.run([*git, "checkout", "-q", "-b", "side"], check=True)
        commit(day)
        if day == 15:
            subprocess.run([*git, "checkout", "-q", "main"], check=True)
            subprocess.run([*git, "merge", "-q", "--no-ff", "-m", "m", "side"], check=True, env=os.environ | {"GIT_COMMITTER_DATE": "2024-01-15T00:00:00+00:00"})
    rows = rework(hunks(spark, [str(tmp_path)])).collect()
    shas = subprocess.run([*git, "log", "--reverse", "--first-parent", "--format=%H"], capture_output=True, text=True, check=True).stdout.split()
    # the commits along first parents, the merge in place of what it brought
    want = Counter()
    for name in files:
        told = subprocess.run([*git, "blame", "--first-parent", "-M0", "--line-porcelain", "HEAD", "--", name], capture_output=True, text=True, check=True).stdout.split("\n")
        want.update(shas.index(x.split()[0]) for x in told if len(x.split(" ")[0]) == 40 and x.split(" ")[0] in shas and len(x.split()) >= 3)
    got = Counter()
    for r in rows:
        got[r["commit"]] += r["left"]
    assert +got == want and sum(want.values()) == sum(len(x) for x in files.values())
    assert {r["life"] for r in rows if r["file"] == "moved.py"} == {"one.py@0"}
    assert {r["life"] for r in rows if r["file"] == "sub/c.py"} == {"sub/c.py@0", "sub/c.py@14"}
    assert all(0 <= r["reworked"] <= r["added"] - r["left"] for r in rows) and any(r["reworked"] for r in rows)


def test_against_lists(spark):
    """Many lives in one table, with lines from before the history, whole-file changes and days at the border."""
    rng = random.Random(5)
    rows, want = [], Counter()
    for life in range(30):
        known, clock = life % 3 > 0, 0
        lines = [] if known else [None] * 9
        for commit in range(rng.randrange(1, 12)):
            clock += rng.choice([0, 1, 7, 14, 15])
            at, edits = 0, []
            while at <= len(lines) and len(edits) < 3:
                begin = rng.randrange(at, len(lines) + 1)
                removed = min(rng.randrange(4), len(lines) - begin)
                edits.append((begin, removed, rng.randrange(4) or int(not removed)))
                at = begin + removed + 1
            for begin, removed, added in reversed(edits):
                for born in lines[begin : begin + removed]:
                    if born and clock - born[1] <= 14:
                        want[life, born[0]] += 1
                lines[begin : begin + removed] = [(commit, clock)] * added
                rows.append(("r", str(life), "f", commit, clock * DAY, begin, removed, added))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    out = rework(table)
    got = {(int(r["life"]), r["commit"]): r["reworked"] for r in out.collect()}
    assert {k: v for k, v in got.items() if v} == dict(want) and want
    share = rework_share(out, "repo").collect()[0]
    assert share["reworked"] == sum(want.values()) and share["added"] == sum(r[-1] for r in rows)
    assert line_moves(table.limit(0)).count() == 0


def test_parsed():
    log = b'commit 2024-01-01T00:00:00+00:00\n\ndiff --git a/x b/x\nnew file mode 100644\n--- /dev/null\n+++ "b/t\\tab\\"\\303\\274"\n@@ -0,0 +1,2 @@\n+++ b/y\n+\n\\ No newline at end of file\ncommit 1970-01-01T00:00:01+00:00\n--- "a/t\\tab\\"\\303\\274"\n+++ /dev/null\n@@ -1,2 +0,0 @@\n---\n-\n'
    got = list(parsed_hunks(iter(log.splitlines(keepends=True))))
    name = 't\tab"ü'
    assert got == [(f"{name}@0", name, 0, 1704067200000000, 0, 0, 2), (f"{name}@0", name, 1, 1000000, 0, 2, 0)]
