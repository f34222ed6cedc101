"""What several operators share: scratch storage, words, and the text reader of the tables."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and Spark runs in this process (tests), below a temporary one that is set then."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. With ``drop_shuffles`` the write's shuffle files go as soon as it ends, not when the driver next collects its garbage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Just doc_id and text, whatever other columns there are."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


#: What a worker remembers from task to task, by name: functions that forget it.
REMEMBERED: dict[str, list] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 2 << 20, holds: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most_bytes`` of the named column (one row at least). What the worker remembers of operators other than ``holds`` is forgotten first."""
    for name, forget in REMEMBERED.items():
        if name != holds:
            for f in forget:
                f()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


#: Freed buffers go back to the system, so that a worker's memory is what its present batch needs.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)


def give_back() -> None:
    """What a task has freed goes back to the system; without it, glibc keeps it in workers that wait for another stage."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def steady() -> None:
    """From now on this worker maps arrays of a megabyte or more by themselves, so that each goes back to the system when it is freed; glibc would raise that bound to 32 MB by itself and keep what lies below."""
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts: fewer rows each than Spark's default, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: An odd multiplier for prefix hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(2)
def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, of: int = BASE) -> np.ndarray:
    return _powers(1 << max(10, (n - 1).bit_length()), of)[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i]: the sum of (data[j] + 1) * BASE**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of an array's strings, all at once."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    h = prefix_hashes(data)
    return mixed((h[ends] - h[begins]) * powers(len(data) + 1, INVERSE)[begins] ^ mixed((ends - begins).astype(np.uint64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-word shingles; A-Z count as a-z, null as empty.

    A text of fewer words is one shingle, one without a word has none.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = words.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(filled)))[np.cumsum(words.value_lengths().to_numpy())]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    if not len(coded):
        return [np.empty(0, np.uint64)] * len(texts)
    h = string_hashes(coded.dictionary)[coded.indices.to_numpy()]
    whole = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        whole = mixed(whole ^ h[i : len(h) - n + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    out, at = [], 0
    for end in ends.tolist():
        if end - at >= n:
            s = np.sort(whole[at : end - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif end > at:
            x = np.full(1, end - at, np.uint64)
            for i in range(at, end):
                x = mixed(x ^ h[i : i + 1]) + np.uint64(0x9E3779B97F4A7C15)
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


#: Bits of a set of marked ids: eight an id within these bounds. The broadcast never grows beyond 32 MB; a fuller set only lets more rows through.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def marks(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes of an id column, which may repeat ids; built by an aggregation that is partial in each task."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(size))
    rows = ids.groupBy(F.floor(place / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    for k, bits in zip(rows["k"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[4096 * k : 4096 * k + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def map_marked(docs: DataFrame, run, schema, bitmap: np.ndarray, wanted: bool = True, column: str = "doc_id") -> DataFrame:
    """mapInArrow with ``run`` over the rows whose id may be marked (all that are, a few more), or, with ``wanted`` false, exactly the others; no shuffle. Null counts as not marked."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)  # MOST_BITS at most
    names = docs.columns
    place, known = (next(c for c in (f"_{what}{i}" for i in range(len(names) + 1)) if c not in names) for what in ("place", "known"))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            at = b.column(place).to_numpy()
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            hit &= b.column(known).to_numpy(zero_copy_only=False)
            yield b.select(names).filter(pa.array(hit == wanted))

    return docs.withColumns({place: F.pmod(F.xxhash64(column), F.lit(8 * len(bitmap))), known: F.col(column).isNotNull()}).mapInArrow(lambda batches: run(filtered(batches)), schema)


def maybe_marked(docs: DataFrame, bitmap: np.ndarray, column: str = "doc_id") -> DataFrame:
    """The rows whose id may be marked, before a join that tells."""
    return map_marked(docs, lambda batches: batches, docs.schema, bitmap, True, column)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (id, component), component the smallest id reachable; ids without an edge are absent.

    Alternates large-star and small-star steps. Each takes the smallest neighbour of every vertex by an aggregation that is partial in each task and joins it back,
    which adaptive execution splits where a vertex has very many neighbours. The edge table is written to the shared folder after every round.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges", True)
    before = None
    while True:
        # large star: each neighbour greater than v goes to the smallest of v and its neighbours
        both = now.select(a.alias("v"), b.alias("n")).unionAll(now.select(b.alias("v"), a.alias("n")))
        least = both.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
        large = both.where("n > v").join(least, "v").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()
        # small star: v and its smaller neighbours all go to the smallest one
        with_m = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = with_m.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now = written(small, "edges", True)
        stats = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("g")).first()
        if tuple(stats) == before:
            break
        before = tuple(stats)
    return written(now.unionAll(now.select("b", "b")).groupBy(a.alias("id")).agg(F.min("b").alias("component")), "components", True)
