"""Quality rules: base counts of each text, and multivariate outliers by minimum covariance determinant.

The counts of a text make a vector of transformed statistics. For each (lang, source) the half of the rows with the
smallest covariance determinant is sought by concentration steps from two deterministic starts, until no step lowers a determinant any more. Every step
is one aggregation over all rows of the groups that still move, by group and rounded distance, so no group is ever gathered in one
place and a group that holds a third of all rows costs what its rows cost. Rows far from their group's centre, by Mahalanobis
distance, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices, utf8, written

#: Fixed values of the contract: white space of words, symbols, the base rule's limits.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20

COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list, n: int = 5) -> int:
    """Words within n-word windows that are found twice or more in the text, the first included."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + n - max(i, upto)
            upto = i + n
    return covered


def text_counts(text: bytes, n_chars: int) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a UTF-8 text of so many code points."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        n_chars - (len(text) - len(text.translate(None, SPACE))),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _counted(b: pa.RecordBatch) -> list[pa.Array]:
    """The six counts of a slice's texts."""
    column = b.column("text").fill_null("")
    rows = np.array([text_counts(t, n) for t, n in zip(utf8(column), pc.utf8_length(column).to_pylist(), strict=True)], np.int64).reshape(-1, 6)
    return list(map(pa.array, rows.T))


def count_texts(docs: DataFrame) -> DataFrame:
    """The counts of every row; text null counts as empty. Only these narrow rows leave the tasks."""
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *_counted(b)], [x.split()[0] for x in COUNTS.split(", ")])

    return src.mapInArrow(run, COUNTS)


#: Dimensions of the statistic vector, in 1/SCALE: integers make every sum exact, so results don't depend on the order of rows.
SCALE = 256
DIMS = 5
#: Standard deviations that no estimate goes below, in the same order: most texts have no symbol and no repetition at all.
FLOORS = (0.5, 0.06, 0.08, 0.15, 0.15)
#: Chi-square with five degrees of freedom: median, and the quantile 0.99999.
CHI_MEDIAN, CHI_CUTOFF = 4.3515, 30.856


def transformed() -> list:
    """Logarithm of the words, of the mean word length and of symbols a word (each drawn to a usual text by 30 words, as short texts vary), roots of the repeated lines' and words' shares."""
    n = F.col("n_words") + 30
    x = [
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 150) / n),
        F.log1p(4 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))) * F.col("n_lines") / (F.col("n_lines") + 5),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(x)]


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
ESTIMATE = "kl string, ks string, start int, m array<double>, p array<double>, det double"


def _estimates(batches: Iterator[pa.RecordBatch], floors: np.ndarray, grown: bool) -> Iterator[pa.RecordBatch]:
    """Centre, inverse scatter and its determinant of each row's (n, sums, sums of products); grown: scatter scaled to the median distance first."""
    for b in batches:
        rows = b.to_pylist()
        out = []
        for r in rows:
            n = max(1, r["n"])
            m = np.array([r[f"s{i}"] for i in range(DIMS)]) / n
            c = np.zeros((DIMS, DIMS))
            for i, j in PAIRS:
                c[i, j] = c[j, i] = r[f"s{i}{j}"] / n - m[i] * m[j]
            c = c * (r["grow"] if grown else 1.0) + np.diag((floors * SCALE) ** 2)
            out.append((r["kl"], r["ks"], r["start"], m.tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])))
        types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [x.split()[0] for x in ESTIMATE.split(", ")])


def _distance():
    d = [F.col(f"x{i}") - F.col("m")[i] for i in range(DIMS)]
    return sum((d[i] * d[j] * F.col("p")[i * DIMS + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


KEYS = ["kl", "ks", "start"]
_SUMS = [*(f"s{i}" for i in range(DIMS)), *(f"s{i}{j}" for i, j in PAIRS)]


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS])


def _small(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """A written table of a row a group, to be broadcast if it is small, else joined by its keys."""
    return F.broadcast(df) if df.count() <= most_rows else df


def _step(vectors: DataFrame, estimates: DataFrame, name: str, grown: bool = False) -> DataFrame:
    """One concentration step: of each group the nearer half of the rows makes the next estimate. Distances are compared as whole 64ths of their logarithm; rows are summed up by them first."""
    near = vectors.join(_small(estimates), ["kl", "ks"]).withColumn("q", F.round(F.log(_distance() + 1e-6) * 64).cast("int"))
    group = Window.partitionBy(*KEYS)  # some hundred distances a group
    shells = _sums(near, *KEYS, "q").withColumn("before", F.sum("n").over(group.orderBy("q")) - F.col("n")).withColumn("of", F.sum("n").over(group))
    half = shells.where(F.col("before") * 2 < F.col("of") + DIMS + 1)
    sums = half.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)], (F.exp(F.max("q") / 64) / CHI_MEDIAN).alias("grow"))
    floors = np.array(FLOORS)
    return written(sums.mapInArrow(lambda b: _estimates(b, floors if grown else floors / 4, grown), ESTIMATE), name)


def _grouped(counted: DataFrame) -> DataFrame:
    """Counts with base_failed, the transformed statistics and the names of the group."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), F.coalesce("lang", F.lit("")).alias("kl"), F.coalesce("source", F.lit("")).alias("source0"), *transformed())


def estimates(counted: DataFrame, least_rows: int = 60, most_steps: int = 100) -> tuple[DataFrame, DataFrame]:
    """(kl, source0, ks) of every group with rows that pass the base rule, and the final estimate (kl, ks, m, p) of each, as written tables."""
    used = _grouped(counted).where(~F.col("base_failed")).select("kl", "source0", *[f"x{i}" for i in range(DIMS)])
    groups = written(used.groupBy("kl", "source0").count().select("kl", "source0", F.when(F.col("count") >= least_rows, F.concat(F.lit("s"), "source0")).otherwise("").alias("ks")), "groups")
    vectors = used.join(_small(groups), ["kl", "source0"]).drop("source0")
    # starts: medians with median absolute deviations, and the same with the correlation of the squashed coordinates
    medians = written(vectors.groupBy("kl", "ks").agg(*[F.percentile(f"x{i}", 0.5).alias(f"c{i}") for i in range(DIMS)]), "medians")
    around = vectors.join(_small(medians), ["kl", "ks"])
    mads = written(around.groupBy("kl", "ks").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(DIMS)], *[F.greatest(1.4826 * F.percentile(F.abs(F.round(F.col(f"x{i}") - F.col(f"c{i}"))), 0.5), F.lit(FLOORS[i] * SCALE / 4)).alias(f"d{i}") for i in range(DIMS)]), "mads")
    squashed = vectors.join(_small(mads), ["kl", "ks"]).select("kl", "ks", *[F.round(SCALE * F.tanh((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}"))).cast("long").alias(f"x{i}") for i in range(DIMS)])
    begun = written(_sums(squashed, "kl", "ks").join(mads, ["kl", "ks"]).mapInArrow(_starts, ESTIMATE), "starts")
    moving, still = _step(vectors, begun, "step0"), []
    for step in range(1, most_steps):
        after = _step(vectors, moving, f"step{step}").select(*KEYS, F.struct("m", "p", "det").alias("after"))
        both = written(moving.join(after, KEYS).withColumn("lower", F.col("after.det") < F.col("det") - 1e-9), "steps")
        still.append(both.where("NOT lower").select(*KEYS, "m", "p", "det"))
        moving = both.where("lower").select(*KEYS, "after.m", "after.p", "after.det")
        if moving.isEmpty():
            break
    else:
        still.append(moving)
    rested = written(reduce(DataFrame.unionByName, still), "rested")
    lowest = written(rested.groupBy("kl", "ks").agg(F.min_by(F.struct("start", "m", "p", "det"), F.struct("det", "start")).alias("e")).select("kl", "ks", "e.*"), "lowest")
    return groups, _step(vectors, lowest, "final", grown=True).drop("start", "det")


def _judged(counted: DataFrame, groups: DataFrame, final: DataFrame, cutoff: float) -> DataFrame:
    told = _grouped(counted).join(_small(groups), ["kl", "source0"], "left").join(_small(final), ["kl", "ks"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))


def judge_quality(docs: DataFrame, least_rows: int = 60, cutoff: float = CHI_CUTOFF) -> DataFrame:
    """Counts of every row of ``docs`` (doc_id, text, lang, source; others are ignored), base_failed, distance (squared) and kept.

    Rows that fail the base rule are not kept and not used. Estimates are per (lang, source), null as empty; sources with fewer than
    ``least_rows`` rows of a language share one estimate of that language. Text null or empty fails the base rule; doc_id is carried as it is; equal rows get equal verdicts; no
    rows: no rows. All rows count; nothing is sampled. A group without variance has that of the floors, so rows that differ much from its only value are rejected.
    """
    counted = written(count_texts(docs), "counts")
    told = _judged(counted, *estimates(counted, least_rows), cutoff)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "lang", "source")


def keep_typical(docs: DataFrame, least_rows: int = 60, cutoff: float = CHI_CUTOFF) -> DataFrame:
    """The rows of ``docs``, with their own columns, that judge_quality keeps. Rows are judged one by one, so null and repeated doc_ids do no harm; texts are counted a second time instead of being joined."""
    counted = written(count_texts(docs), "counts")
    groups, final = estimates(counted, least_rows)
    # the columns ride as one struct, so that none of their names can clash
    whole = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    names = [x.split()[0] for x in COUNTS.split(", ")][3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("source"), b.column("row"), *_counted(b)], ["lang", "source", "row", *names])

    schema = StructType([StructField("lang", StringType()), StructField("source", StringType()), whole.schema["row"], *[StructField(n, LongType()) for n in names]])
    rows = whole.mapInArrow(run, schema)
    return _judged(rows, groups, final, cutoff).where("kept").select("row.*")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            n, m, d = max(1, r["n"]), np.array([r[f"c{i}"] for i in range(DIMS)]), np.array([r[f"d{i}"] for i in range(DIMS)])
            c = np.eye(DIMS)
            s = np.array([r[f"s{i}"] for i in range(DIMS)]) / n
            for i, j in PAIRS:
                c[i, j] = c[j, i] = r[f"s{i}{j}"] / n - s[i] * s[j]
            sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
            correlation = 0.9 * c / np.outer(sd, sd)
            np.fill_diagonal(correlation, 1)
            for start, scatter in enumerate((np.diag(d**2), correlation * np.outer(d, d))):
                out.append((r["kl"], r["ks"], start, m.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
        types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [x.split()[0] for x in ESTIMATE.split(", ")])
