"""Python files of source trees as a batch data source that opens only what filters let through."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from ..functions.paths import NON_SOURCE, TEST_DATA
from ..functions.scratch import written
from ..functions.text import normalized
from .files import SUFFIX, listing

SCHEMA = "repo string, path string, absolute string, mtime double, length long, test boolean, non_source boolean, content binary, error string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()]
#: Columns that a listing tells, so that filters on them need no file opened.
TOLD = {"repo", "path", "length", "mtime", "test", "non_source"}


def classes(path: str) -> tuple[bool, bool]:
    """(test, non_source) of a path, as is_test and is_non_source have them."""
    *_, name = parts = path.split("/")
    named = name.startswith("test_") or name.endswith("_test.py")
    return path.endswith(SUFFIX) and named and not set(parts) & set(TEST_DATA), named or bool(set(parts) & set(NON_SOURCE))


def passes(f: Filter, row: dict) -> bool:
    """Whether a listed file passes a filter; comparisons with null don't."""
    if isinstance(f, Not):
        child = f.child
        return (isinstance(child, EqualNullSafe) or row[child.attribute[0]] is not None) and not passes(child, row)
    have = row[f.attribute[0]]
    if isinstance(f, EqualNullSafe):
        return have == f.value
    if have is None:
        return False
    if isinstance(f, In):
        return have in f.value
    tests = {EqualTo: have.__eq__, GreaterThan: have.__gt__, GreaterThanOrEqual: have.__ge__, LessThan: have.__lt__, LessThanOrEqual: have.__le__}
    if type(f) in tests:
        return tests[type(f)](f.value) is True
    return {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(f)](have, f.value)


SUPPORTED = (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


@dataclass
class Files(InputPartition):
    rows: list[tuple]


class TreesReader(DataSourceReader):
    """Lists trees when the query is planned, as Spark's own file sources do, and deals the files that filters let through to tasks by their bytes."""

    def __init__(self, repos: list[str], most_bytes: int):
        self.repos, self.most_bytes, self.filters = repos, most_bytes, []

    def listed(self) -> Iterator[tuple]:
        for repo in self.repos:
            for root, path, absolute, _, mtime, length in listing(repo):
                row = dict(zip(COLUMNS, (root, path, absolute, mtime, length, *classes(path)), strict=False))
                if all(passes(f, row) for f in self.filters):
                    yield tuple(row.values())

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for row in self.listed():
            if out[-1].rows and size + row[4] > self.most_bytes:
                out.append(Files([]))
                size = 0
            out[-1].rows.append(row)
            size += row[4]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Opens each file of a part; one that can't be read keeps its row, with the error and without content."""
        rows, size = [], 0
        for row in partition.rows:
            content = error = None
            try:
                content = Path(row[2]).read_bytes()
            except OSError as e:
                error = f"{type(e).__name__}: {e.strerror or e}"
            rows.append((*row, content, error))
            size += len(content or b"")
            if size > 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


class PushingReader(TreesReader):
    """The reader of a session that pushes filters into Python sources; Spark refuses it in any other."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what a listing can tell; Spark sees to the rest."""
        for f in filters:
            plain = f.child if isinstance(f, Not) else f
            if isinstance(plain, SUPPORTED) and len(plain.attribute) == 1 and plain.attribute[0] in TOLD:
                self.filters.append(f)
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], COLUMNS)


class Trees(DataSource):
    """spark.read.format("trees").option("repos", a JSON list of folders).option("most_bytes", of a task's files). With option push and spark.sql.python.filterPushdown.enabled, filters on repo, path, length, mtime, test and non_source decide which files are opened."""

    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreesReader:
        kind = PushingReader if str(self.options.get("push", "false")).lower() == "true" else TreesReader
        return kind(json.loads(self.options["repos"]), int(self.options.get("most_bytes", 16 << 20)))


def read_trees(spark: SparkSession, repos: list[str | Path], most_bytes: int = 16 << 20, push: bool = False) -> DataFrame:
    """Files of trees with content, error and normalised text. Paths must be readable from the executors; a tree that can't be listed is an error.

    With ``push`` the reader takes filters, for sessions that have spark.sql.python.filterPushdown.enabled set, as ``written_pushing`` does; without, Spark filters what was opened.
    """
    spark.dataSource.register(Trees)
    rows = spark.read.format("trees").option("repos", json.dumps([str(r) for r in repos])).option("most_bytes", most_bytes).option("push", push).load()
    return rows.withColumn("text", normalized(F.make_valid_utf8(F.col("content").cast("string"))))


def written_pushing(files: DataFrame, name: str) -> DataFrame:
    """Rows of read_trees with ``push``, filtered by the reader where it can, written once; the session's own setting is as before afterwards."""
    conf, key = files.sparkSession.conf, "spark.sql.python.filterPushdown.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return written(files, name)
    finally:
        conf.set(key, before)
