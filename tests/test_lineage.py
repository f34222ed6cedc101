"""Lives of names through renames, against git itself."""

import os
import subprocess

from pyspark.sql import functions as F

from treewarden.sources import history


def test_names_followed(spark, tmp_path):
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", "-c", "diff.renames=true"]
    day = iter(range(1, 28))

    def commit(*steps):
        for step in steps:
            if step[0] == "put":
                (tmp_path / step[1]).parent.mkdir(exist_ok=True)
                (tmp_path / step[1]).write_text("".join(f"{step[2]}_{i} = {i}\n" for i in range(20)))
                subprocess.run([*git, "add", step[1]], check=True)
            else:
                if step[0] == "mv":
                    (tmp_path / step[2]).parent.mkdir(exist_ok=True)
                subprocess.run([*git, *step], check=True, stdout=subprocess.DEVNULL)
        when = f"2024-01-{next(day):02d}T00:00:00+00:00"
        subprocess.run([*git, "commit", "-qm", "x"], check=True, env=os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})

    subprocess.run([*git, "init", "-q"], check=True)
    commit(("put", "one.py", "one"), ("put", "a.py", "a"))
    commit(("put", "b.py", "b"))
    commit(("mv", "one.py", "two.py"))
    commit(("mv", "a.py", "tmp.py"))  # a and b swap names in three steps
    commit(("mv", "b.py", "a.py"))
    commit(("mv", "tmp.py", "b.py"))
    commit(("mv", "two.py", "pkg/three.py"))
    commit(("put", "one.py", "again"))  # a name that is used again
    commit(("rm", "-q", "one.py"))
    commit(("put", "one.py", "third"))
    log = subprocess.run([*git, "log", "-M", "--name-status", "--format=@%cI"], capture_output=True, text=True, check=True).stdout
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(log.split("\n")) if x], "repo string, n int, value string").repartition(5)
    got = {r["file"]: (r["first"].day, r["first_name"]) for r in history.first_commits_of_lives(lines).collect() if (tmp_path / r["file"]).exists()}
    assert got == {"pkg/three.py": (1, "one.py"), "b.py": (1, "a.py"), "a.py": (2, "b.py"), "one.py": (10, "one.py")}
    for file in ("pkg/three.py", "b.py", "a.py"):
        told = subprocess.run([*git, "log", "--follow", "--format=%cI", "--", file], capture_output=True, text=True, check=True).stdout.split()
        assert got[file][0] == int(told[-1][8:10])
    assert history.lives(lines).where("file = 'one.py'").count() == 3


def test_renames_of_numstat(spark):
    names = ["a.py", "a.py => b.py", "x/{a.py => b.py}", "x/{ => y}/a.py", "{x => }/y/a.py", "a/{b => c/d}/e.py"]
    df = spark.createDataFrame([("r", f"1\t2\t{n}") for n in names], "repo string, value string")
    assert sorted(r["file"] for r in history.numstat(df, ["repo"], follow=True).collect()) == sorted(["a.py", "b.py", "x/b.py", "x/y/a.py", "y/a.py", "a/c/d/e.py"])
    assert {r["file"] for r in history.numstat(df, ["repo"]).collect()} == {n for n in names if n.endswith(".py")}
    assert df.select(history.renamed_to(F.lit("plain.py"))).first()[0] == "plain.py"
