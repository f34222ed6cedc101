"""Lines that many documents share, by DataFrame functions alone.

Every line becomes its key's 128-bit hash with document and position. The hashes are dealt by ranges, sorted by hash, document and
position, and streamed: the first occurrence of a key in each document counts. Keys of enough documents mark their occurrences, and
each document gets a compressed bitmap of the lines it keeps; texts never ride along with hashes. A range ends within a key where the
key is common, as documents are part of what ranges are cut by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What is stripped from both ends of a line.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """Of each line with a key of ``least_chars`` code points: hash (h1, h2), doc_id, row (hash of the text, which tells rows of one doc_id apart), pos and first (its key's first line in the document).

    Written once to the shared folder, in ranges of (h1, h2, doc_id).
    """
    line = F.posexplode(F.transform(lines_of(docs["text"]), line_key)).alias("pos", "key")
    keyed = docs.select("doc_id", "row", line).where(F.length("key") >= least_chars)
    dealt = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "pos").repartitionByRange("h1", "h2", "doc_id")
    by = Window.partitionBy("h1", "h2", "doc_id").orderBy("row", "pos")
    return written(dealt.withColumn("first", F.row_number().over(by) == 1), "lines")


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, row, bitmap) of each row of ``docs`` (doc_id, row, text) that loses lines: those whose key is found in ``least_docs`` documents or more.

    bitmap is the run-length form of a bitmap: (start, length) of each run of lines that go, in order; all others are kept. With
    ``keep_first`` the first of all occurrences of a key, by doc_id, row and position, stays.
    """
    lines = occurrences(docs, least_chars)
    place = F.struct("doc_id", "row", "pos")
    shared = lines.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("begins")).where(F.col("n") >= least_docs).select("h1", "h2", "begins")
    going = lines.drop("first").join(shared, ["h1", "h2"])
    if keep_first:
        going = going.where(~place.eqNullSafe(F.col("begins")))
    at = going.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("p"))  # no more than a document's lines
    p, last = F.col("p"), F.size("p") - 1
    starts = F.filter(p, lambda x, i: (i == 0) | (p[F.greatest(i - 1, F.lit(0))] < x - 1))
    ends = F.filter(p, lambda x, i: (i == last) | (p[F.least(i + 1, last)] > x + 1))
    return at.select("doc_id", "row", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("bitmap"))


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps, each copied once; a null bitmap keeps all."""
    starts = F.concat(F.array(F.lit(0)), F.transform(bitmap, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(bitmap, lambda r: r["start"]), F.array(F.size(lines)))
    return F.when(bitmap.isNull(), lines).otherwise(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))))


def drop_shared_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, text (the kept lines joined by line feeds), n_lines and n_dropped.

    Null and empty texts are one empty line. Rows of one doc_id (those without an id are one too) count as one document, and each
    row keeps its own lines; equal rows lose the same lines. An empty key (under ``least_chars`` code points) never goes. An empty table gives an
    empty table; other columns are left out.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    going = keep_bitmaps(own, least_docs, least_chars, keep_first).select(F.col("doc_id").alias("its"), F.col("row").alias("of"), "bitmap")
    all_lines = own.join(going, own["doc_id"].eqNullSafe(F.col("its")) & (own["row"] == F.col("of")), "left").select("doc_id", lines_of(F.col("text")).alias("lines"), "bitmap")
    dropped = F.aggregate(F.col("bitmap"), F.lit(0).cast("long"), lambda n, r: n + r["length"])
    return all_lines.select("doc_id", F.array_join(kept_lines(F.col("lines"), F.col("bitmap")), "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).alias("n_dropped"))


def digests(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (lowercase hex of the kept text's UTF-8) of every row."""
    return drop_shared_lines(docs, least_docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
