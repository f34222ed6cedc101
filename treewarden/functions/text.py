"""Text as files are read: no byte order mark, one kind of line end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def line_count(text: Column) -> Column:
    """Newlines, and one more if the text doesn't end with one; so an empty text has one line."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return newlines + F.when(text.endswith("\n"), 0).otherwise(1)
