"""A source of change events: a tree polled into a stream.

Every read compares the tree with the snapshot of the offset before. What a batch held is kept by Spark's simple reader until it
is committed, so a batch that is repeated is the same although files have moved on.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .files import listing


class TreeStream(SimpleDataSourceStreamReader):
    """``quiet``: so many seconds must have passed since the last change. ``snapshots``: a folder that every reader sees, for the listings that offsets name; without it an offset holds its listing."""

    def __init__(self, repo: str, quiet: float = 0.0, snapshots: str | None = None):
        self.repo, self.quiet, self.snapshots = repo, quiet, snapshots

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _files(self, offset: dict) -> dict:
        return json.loads(Path(self.snapshots, offset["at"]).read_text()) if "at" in offset else json.loads(offset["files"])

    def _offset(self, files: dict) -> dict:
        text = json.dumps(files, sort_keys=True)
        if not self.snapshots:
            return {"files": text}
        name = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
        Path(self.snapshots).mkdir(parents=True, exist_ok=True)
        part = Path(self.snapshots, f"{name}.{uuid.uuid4().hex}")
        part.write_text(text)
        part.replace(Path(self.snapshots, name))
        return {"at": name}

    def _events(self, old: dict, new: dict) -> Iterator[tuple]:
        rows = [(self.repo, p, "added" if p not in old else "modified", new[p]) for p in sorted(new) if old.get(p) != new[p]]
        return iter(rows + [(self.repo, p, "deleted", old[p]) for p in sorted(set(old) - set(new))])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = self._files(start), {r[1]: r[4] for r in listing(self.repo)}
        if old == new or self.quiet and time.time() - max(new.values(), default=0) < self.quiet:
            return iter(()), start
        return self._events(old, new), self._offset(new)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._events(self._files(start), self._files(end))


class TreeSource(DataSource):
    """spark.dataSource.register(TreeSource); spark.readStream.format("tree").option("repo", ...).load(); options quiet and snapshots as of TreeStream."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "repo string, path string, status string, mtime double"

    def simpleStreamReader(self, schema) -> TreeStream:
        return TreeStream(self.options["repo"], float(self.options.get("quiet", 0)), self.options.get("snapshots"))
