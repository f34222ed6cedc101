"""Lines followed from commit to commit: which of those that a commit added were taken out or written anew, and how soon."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIFE = ["repo", "life"]
_MOVED = "repo string, life string, file string, commit long, at_micros long, gone long, gone_micros long, lines long"


class _Lines:
    """One file's lines as runs of (how many, who added them), None for those from before its history."""

    def __init__(self):
        self.runs: list[tuple[int, tuple | None]] = []

    def change(self, hunks: list[tuple[int, int, int]], who: tuple) -> dict[tuple, int]:
        """Applies one commit's hunks (begin, removed, added), in order of begin; returns how many lines of whom went. One pass over the runs."""
        after: list[tuple[int, tuple | None]] = []
        gone: dict[tuple, int] = {}
        at, run, left = 0, 0, self.runs[0][0] if self.runs else 0

        def taken(n: int) -> Iterator[tuple[int, tuple | None]]:
            nonlocal run, left
            while n > 0 and run < len(self.runs):
                some = min(n, left)
                if some:
                    yield some, self.runs[run][1]
                n, left = n - some, left - some
                if not left:
                    run += 1
                    left = self.runs[run][0] if run < len(self.runs) else 0
            if n > 0:  # lines from before the history
                yield n, None

        def put(n: int, of: tuple | None) -> None:
            if after and after[-1][1] == of:
                after[-1] = (after[-1][0] + n, of)
            else:
                after.append((n, of))

        for begin, removed, added in hunks:
            for n, of in taken(begin - at):
                put(n, of)
            for n, of in taken(removed):
                if of is not None:
                    gone[of] = gone.get(of, 0) + n
            if added:
                put(added, who)
            at = begin + removed
        for n, of in taken(sum(n for n, _ in self.runs[run + 1 :]) + left):
            put(n, of)
        self.runs = after
        return gone


def line_moves(hunks: DataFrame) -> DataFrame:
    """Of hunks (repo, life, file, commit, at_micros, begin, removed, added): (repo, life, file, commit, at_micros, gone, gone_micros, lines), how many lines a commit added to a file (gone null) and how many of them each later commit took out.

    One stream a life, in order of commits, which remembers the runs of the file as it is and one commit's hunks: a file of a long history is one task's time, not its memory.
    Lines from before the first hunk of a life count for nobody. ``file`` is the name at the time the lines were added.
    """
    names = [x.split()[0] for x in _MOVED.split(", ")]
    types = [pa.string()] * 3 + [pa.int64()] * 5
    columns = ["repo", "life", "commit", "file", "at_micros", "begin", "removed", "added"]
    in_order = hunks.select(*columns).repartition(*LIFE).sortWithinPartitions(*LIFE, "commit", "begin", "removed")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, lines, todo, who = None, _Lines(), [], None

        def settle() -> None:
            if not todo:
                return
            file, commit, at = who
            rows.extend((*now[0], *of, commit, at, n) for of, n in lines.change(todo, who).items())
            if added := sum(h[2] for h in todo):
                rows.append((*now[0], file, commit, at, None, None, added))

        for b in batches:
            for repo, life, commit, file, at, *hunk in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if now != ((repo, life), commit):
                    settle()
                    if now is None or now[0] != (repo, life):
                        lines = _Lines()
                    now, who, todo = ((repo, life), commit), (file, commit, at), []
                todo.append(tuple(hunk))
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                rows = []
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return in_order.mapInArrow(followed, _MOVED)


def rework(hunks: DataFrame, days: int = 14) -> DataFrame:
    """(repo, life, file, commit, at, added, reworked, left) of each commit and file with added lines: how many it added, how many of these a commit at most ``days`` days later took out or wrote anew, and how many the last commit still has. A commit dated before the one whose lines it takes counts as one on its day."""
    soon = F.col("gone_micros") - F.col("at_micros") <= days * 86_400_000_000
    added = F.sum(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(0))
    out = line_moves(hunks).groupBy(*LIFE, "file", "commit", F.timestamp_micros("at_micros").alias("at"))
    return out.agg(added.alias("added"), F.sum(F.when(soon, F.col("lines")).otherwise(0)).alias("reworked"), (added - F.sum(F.when(F.col("gone").isNotNull(), F.col("lines")).otherwise(0))).alias("left"))


def rework_share(rows: DataFrame, *by: str) -> DataFrame:
    """added, reworked and their ratio of ``rework``'s rows, summed up by the given columns."""
    return rows.groupBy(*by).agg(F.sum("added").alias("added"), F.sum("reworked").alias("reworked")).withColumn("share", F.col("reworked") / F.col("added"))
