"""Hunks of repositories' histories: which lines each commit took out of a file and put in, along first parents."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import commit_of

SCHEMA = "repo string, life string, file string, commit long, at_micros long, begin long, removed long, added long"
_RANGES = re.compile(rb"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_ESCAPES = {b"a": b"\a", b"b": b"\b", b"t": b"\t", b"n": b"\n", b"v": b"\v", b"f": b"\f", b"r": b"\r"}
_DIFF = ["--reverse", "--first-parent", "--diff-merges=first-parent", "-p", "-U0", "-M", "--text", "--no-color", "--no-ext-diff", "--no-textconv", "--src-prefix=a/", "--dst-prefix=b/", "--format=commit %cI"]


def _name(raw: bytes) -> str:
    """A name as git writes it, in quotes if some character needs it."""
    raw = raw.rstrip(b"\t")
    if raw.startswith(b'"'):
        raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), raw[1:-1])
    return raw.decode("utf-8", "replace")


def parsed_hunks(lines: Iterator[bytes]) -> Iterator[tuple]:
    """(life, file, commit, at_micros, begin, removed, added) of a log with hunks without context, oldest first, read as a stream.

    ``commit`` counts from 0 on. ``begin`` lines of the file as it was stand before the hunk. A life is a file from where it was added on, through renames; it is
    named after its first name and commit. Files without lines have no rows.
    """
    lives: dict[str, str] = {}  # of names, before the commit at hand
    gone: set[str] = set()
    fresh: dict[str, str] = {}
    commit, at, old, content, life, file = -1, 0, b"", 0, "", ""
    for line in lines:
        line = line.rstrip(b"\n")
        if content:
            content -= not line.startswith(b"\\")
        elif line.startswith(b"commit "):
            for name in gone:
                lives.pop(name, None)
            lives.update(fresh)
            gone, fresh = set(), {}
            commit, at = commit + 1, round(datetime.fromisoformat(line[7:].decode()).timestamp() * 1_000_000)
        elif line.startswith(b"rename from "):
            old = line[12:]
        elif line.startswith(b"rename to "):
            before, file = _name(old), _name(line[10:])
            life = lives.get(before, f"{before}@{commit}")
            gone.add(before)
            fresh[file] = life
        elif line.startswith(b"--- "):
            old = line[4:]
        elif line.startswith(b"+++ "):
            new = line[4:]
            before, file = (None if side.rstrip(b"\t") == b"/dev/null" else _name(side).split("/", 1)[1] for side in (old, new))
            life = f"{file}@{commit}" if before is None else lives.get(before, f"{before}@{commit}")
            if file is None:
                gone.add(before)
                file = before
            else:
                fresh[file] = life
        elif m := _RANGES.match(line):
            removed, added = (1 if n is None else int(n) for n in (m[2], m[3]))
            content = removed + added
            yield life, file, commit, at, int(m[1]) - (removed > 0), removed, added


def hunks(spark: SparkSession, repos: list[str], head: str = "HEAD") -> DataFrame:
    """Hunks of the histories of ``repos`` up to ``head``, a task a repository, which reads git's output as a stream; repositories must be readable from the executors, and git's own failure is an error."""
    heads = [(str(r), commit_of(r, head)) for r in repos]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string()] * 3 + [pa.int64()] * 5

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, sha in zip(b.column("repo").to_pylist(), b.column("sha").to_pylist(), strict=True):
                with subprocess.Popen(["git", "-C", repo, "-c", "core.quotePath=false", "-c", "log.showRoot=true", "log", *_DIFF, sha, "--"], stdout=subprocess.PIPE) as told:
                    rows = []
                    for hunk in parsed_hunks(told.stdout):
                        rows.append((repo, *hunk))
                        if len(rows) == 20_000:
                            yield batch(rows)
                            rows = []
                    yield batch(rows)
                if told.returncode:
                    raise RuntimeError(f"git log failed in {repo}: {told.returncode}")

    return spark.createDataFrame(heads, "repo string, sha string").repartition(max(1, len(heads)), "repo").mapInArrow(run, SCHEMA)
