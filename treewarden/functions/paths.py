"""Classes of paths, as predicates on a path column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder names of code that isn't shipped, and of data that only looks like tests.
NON_SOURCE = ("tests", "test", "testing", "examples", "example", "docs_src", "docs", "doc")
TEST_DATA = ("data", "fixtures")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _within(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_non_source(path: Column) -> Column:
    """Tests, examples and docs by file name or by any segment."""
    name = basename(path)
    return name.startswith("test_") | name.endswith("_test.py") | _within(path, NON_SOURCE)


def is_test(path: Column) -> Column:
    """Test modules, outside data and fixture folders."""
    name = basename(path)
    return path.endswith(".py") & (name.startswith("test_") | name.endswith("_test.py")) & ~_within(path, TEST_DATA)


def is_named_test(path: Column) -> Column:
    """Test modules by prefix alone."""
    return basename(path).startswith("test_") & path.endswith(".py")
