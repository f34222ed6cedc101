"""Trailing debounce and phases of many trees in one stream, as state by tree with timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Phases of a tree, in turn: nothing changes; changes come and the tree isn't quiet yet; it is quiet and a scan is due.
IDLE, DEBOUNCING, SCANNING = "idle", "debouncing", "scanning"
PHASES = "repo string, at timestamp, phase string, began timestamp, changes long, prev_ms long"
#: What is remembered of a tree: the burst under way (changes 0: none), and when its phase began.
BURST = "began long, last long, changes long, phase_at long"


class Debounce(StatefulProcessor):
    """Changes of a tree that follow each other within ``quiet`` milliseconds (exactly as many too) are one burst, and a scan is due that long after its last one.

    A timer stands a millisecond beyond where the burst would end; changes push it on. Times are milliseconds of the changes, so a batch that is repeated after a restart says the same.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", BURST)

    def close(self) -> None:
        pass

    def _ended(self, repo: str, began: int, last: int, changes: int, phase_at: int) -> tuple:
        due = last + self.quiet
        return (repo, due, SCANNING, began, changes, due - phase_at)

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["repo", "at", "phase", "began", "changes", "prev_ms"])
        for c in ("at", "began"):
            out[c] = pd.to_datetime(out[c], unit="ms")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        repo, out = key[0], []
        began, last, changes, phase_at = self.burst.get() if self.burst.exists() else (0, 0, 0, None)
        before = last + self.quiet + 1 if changes else None
        for t in sorted(int(t) for part in rows for t in part["ms"]):  # one tree's changes of one batch
            if changes and t > last + self.quiet:
                out.append(self._ended(repo, began, last, changes, phase_at))
                phase_at, changes = last + self.quiet, 0
            if not changes:
                out.append((repo, t, DEBOUNCING, t, 0, None if phase_at is None else t - phase_at))
                began, last, phase_at = t, t, t
            began, last, changes = min(began, t), max(last, t), changes + 1
        self.burst.update((began, last, changes, phase_at))
        if before != last + self.quiet + 1:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(last + self.quiet + 1)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, last, changes, phase_at = self.burst.get()
        if changes and last + self.quiet < expiredTimerInfo.getExpiryTimeInMs():
            self.burst.update((began, last, 0, last + self.quiet))
            yield self._rows([self._ended(key[0], began, last, changes, phase_at)])


def phases(changes: DataFrame, quiet_ms: int, at: str = "at", late: str = "0 seconds") -> DataFrame:
    """The phases that trees of a stream of changes (repo, at) enter: ``debouncing`` at the first change of a burst, ``scanning`` when it has been quiet for ``quiet_ms``,
    with the burst's begin and number of changes; prev_ms is the time since the tree's phase before, null for its first.

    Changes that are later than ``late`` behind the newest one are left out, and a burst ends when the newest change of any tree is that far beyond it. Needs the RocksDB state store. Times are to the
    millisecond; a null repo is a tree too, rows without a time are left out.
    """
    own = changes.where(F.col(at).isNotNull()).withWatermark(at, late).select("repo", F.col(at).alias("at"), F.unix_millis(F.col(at)).alias("ms"))
    return own.groupBy("repo").transformWithStateInPandas(Debounce(quiet_ms), outputStructType=PHASES, outputMode="Append", timeMode="EventTime")


def follow_trees(changes: DataFrame, quiet_ms: int, checkpoint: str, rescan: Callable[[list[str], int], None], once: bool = False, every: str = "500 milliseconds", **options):
    """Starts a query that hands the trees whose scan is due to ``rescan``, with the batch's number: a list as long as there are trees that changed.

    A batch that fails stops the query and is repeated with the same trees and number after a restart, so a scan that is kept by number is neither lost nor doubled.
    """

    def due(batch: DataFrame, number: int) -> None:
        repos = [r["repo"] for r in batch.where(F.col("phase") == SCANNING).select("repo").distinct().orderBy("repo").collect()]
        if repos:
            rescan(repos, number)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return phases(changes, quiet_ms, **options).writeStream.foreachBatch(due).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
