"""Changes between snapshots, as batch operators and as a Structured Streaming job."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .state import Incremental

#: Names that editors write on the way.
EDITOR_TEMPS = (".swp", ".swo", "~", ".tmp")


def editor_temp(path):
    name = F.element_at(F.split(path, "/"), -1)
    out = name.startswith(".#")
    for end in EDITOR_TEMPS:
        out = out | name.endswith(end)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path",), version: str = "version") -> DataFrame:
    """Added, deleted and modified keys of two snapshots."""
    a = old.select(*keys, F.col(version).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(version).alias("_new"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status")).where("status IS NOT NULL")


def merged(cached: DataFrame, fresh: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Cached rows of unchanged files, fresh rows of added and modified ones; deleted files drop out."""
    touched = changes.select(*keys)
    return cached.join(touched, list(keys), "left_anti").unionByName(fresh.join(changes.where("status != 'deleted'").select(*keys), list(keys), "left_semi"))


def first_changed(changes: DataFrame, most: int = 20) -> DataFrame:
    """The first changed paths in order."""
    return changes.select("path").distinct().orderBy("path").limit(most)


def elapsed(events: DataFrame) -> DataFrame:
    """events (repo, at, phase) with the milliseconds since the phase before."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    return events.withColumn("prev_ms", F.floor((at - F.lag(at).over(Window.partitionBy("repo").orderBy("at"))) / 1000))


def version_deltas(members: DataFrame) -> DataFrame:
    """members (version, id): how many ids are new in each version and how many went since the one before."""
    m = members.distinct()
    versions = m.select("version").distinct()  # a row a version
    order = Window.orderBy("version")
    steps = versions.select("version", F.lag("version").over(order).alias("before"), F.lead("version").over(order).alias("after"))
    seen = m.join(steps, "version")
    prev, nxt = m.select(F.col("version").alias("before"), "id"), m.select(F.col("version").alias("after"), "id")
    new = seen.join(prev, ["before", "id"], "left_anti").groupBy("version").agg(F.count("*").alias("new"))
    gone = seen.where("after IS NOT NULL").join(nxt, ["after", "id"], "left_anti").groupBy(F.col("after").alias("version")).agg(F.count("*").alias("gone"))
    return versions.join(new, "version", "left").join(gone, "version", "left").select("version", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("gone", F.lit(0)).alias("gone"))


def debounced(changes: DataFrame, quiet: str, at: str = "at", key: str = "repo") -> DataFrame:
    """Changes (batch or stream) of a key that follow each other within the quiet time are one session."""
    return changes.groupBy(key, F.session_window(at, quiet)).agg(F.count("*").alias("changes")).select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("quiet_at"), "changes")


def watch(changes: DataFrame, checkpoint: str, scan: Callable[[DataFrame, int], None], once: bool = False, every: str = "500 milliseconds"):
    """Starts a query that hands every micro-batch of change events to ``scan`` with its number, which serves as the version.

    A batch that fails stops the query, which repeats it after a restart: ``scan`` should write by version.
    """
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return changes.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def follow(changes: DataFrame, state: Incremental, list_files: Callable[[], DataFrame], checkpoint: str, emit: Callable[[dict], None], once: bool = False, every: str = "500 milliseconds"):
    """Starts a query that scans at every micro-batch of change events and hands the new version's state to ``emit``; with ``once`` it ends after what there is now.

    A scan that fails is handed on as {"error": ...} and the stream goes on: versions are compared with the files themselves, so the next scan catches up.
    """

    def scan(batch: DataFrame, number: int) -> None:
        try:
            emit(state.scan(list_files()))
        except Exception as e:  # a tree that is gone, a full disk: the next event tries again
            emit({"error": f"{type(e).__name__}: {str(e)[:200]}", "batch": number})

    return watch(changes, checkpoint, scan, once, every)


def emit_lines(out, state: Incremental) -> Callable[[dict], None]:
    """An ``emit`` that writes a line of JSON per version: its state and its findings in report order."""
    from ..operators.findings import ORDER

    def emit(now: dict) -> None:
        out.write(json.dumps(now, ensure_ascii=False)[:-1])
        if "error" not in now:
            between = ', "findings": ['
            for x in state.findings(now["version"]).orderBy(*ORDER).toJSON().toLocalIterator():
                out.write(between + x)
                between = ", "
            out.write("]" if between == ", " else between + "]")
        out.write("}\n")
        out.flush()

    return emit
