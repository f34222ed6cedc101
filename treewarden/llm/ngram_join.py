"""Exact Jaccard self-join on word n-grams with a token-group matrix.

1. Each text becomes its set of n-gram hashes. Equal sets become one class, represented by its smallest doc_id.
2. All sets are sorted by one order of tokens, rare before common ones. Two sets with the wanted similarity share a token in
   their prefixes (the first size - ceil(t * size) + 1 tokens).
3. Grouping: within each prefix token every class is compared with the token's smallest class only, which is linear however many share
   the token. Similar pairs join classes into groups.
4. Matrix: (token, group) rows over prefixes, and of each group the union of its members' tokens, as a bitmap of fixed size. A
   class is a candidate for the larger groups that share one of its prefix tokens, with members of fitting size, and enough tokens from
   there on in both. The union bounds the overlap with any member from above; only groups whose bound suffices are opened, and their
   members that share a prefix token are compared. Pairs inside a group are never made, so a large group of copies stays linear.
5. Comparisons count exact overlaps of sorted token arrays. Links of 3 and 4 give the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, id_and_text, map_marked, marks, maybe_marked, shingle_sets, slices, written

#: Bits of a group's tokens, and of a class's at least; tokens that so many texts hold, of those counted at once, are counted as common; so many common tokens at most are told apart.
BITS, COMMON_IN_BATCH, TOKENS_AT_ONCE, MOST_COMMON = 4096, 4, 1_500_000, 1_000_000


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    for b in slices(batches, most_bytes=2 << 20):
        yield b, shingle_sets(b.column("text"), n)


def common_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens that many texts hold, most common last. They only set the order of tokens, which any choice keeps right; so counts below COMMON_IN_BATCH in a batch are left out and the number is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            tokens = np.concatenate([np.empty(0, np.uint64), *held])
            held.clear()
            tokens.sort()
            ends = np.flatnonzero(np.concatenate((tokens[1:] != tokens[:-1], [True]))) if len(tokens) else np.empty(0, np.int64)
            counts = np.diff(ends, prepend=-1)
            often = counts >= COMMON_IN_BATCH
            return pa.record_batch({"token": tokens[ends[often]].view(np.int64), "n": counts[often].astype(np.int64)})

        size = 0
        for _, sets in _sets(batches, n):
            held += sets
            size += sum(map(len, sets))
            if size > TOKENS_AT_ONCE:
                yield counted()
                size = 0
        yield counted()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 16")
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    return top["token"].to_numpy()[::-1].copy().view(np.uint64)


def least_overlap(size, percent: int):
    """The least overlap of two sets with the wanted similarity, of which one has that size."""
    return -(-size * percent // 100)


def _arrays(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """Size and digest of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, n):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary")


class Texts:
    """The texts to join: those that can't be copies, straight from the table, and of the others the ones that are none."""

    def __init__(self, src: DataFrame, bitmap: np.ndarray, reps: DataFrame):
        self.src, self.bitmap = src, bitmap
        self.rest = maybe_marked(src, bitmap).join(reps.hint("merge"), "doc_id", "left_semi")  # a shuffle between the two Python passes, so that a task needs one worker

    def map(self, run, schema: str) -> DataFrame:
        return map_marked(self.src, run, schema, self.bitmap, False).unionAll(self.rest.mapInArrow(run, schema))


def prefixes(docs: Texts, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """Size and prefix of each row's set; empty sets have no row."""
    held = docs.src.sparkSession.sparkContext.broadcast(common)  # MOST_COMMON tokens at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(held.value)
        common = held.value[order]
        for b, sets in _sets(batches, n):
            out = []
            for s in sets:
                k = len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    is_common = common[at] == s
                    rare = s[~is_common]
                    out.append((rare if len(rare) >= k else np.concatenate((rare, s[is_common][np.argsort(order[at[is_common]])])))[:k])
                else:
                    out.append(s[:k])
            yield pa.record_batch({"id": b.column("doc_id"), "size": pa.array([len(s) for s in sets], pa.int64()), "prefix": _arrays(out)})

    return docs.map(run, "id long, size long, prefix array<long>").where("size > 0")


def bitmaps(docs: DataFrame, n: int, marked: np.ndarray) -> DataFrame:
    """(id, size, bits) of the rows that may be marked, in one pass: which slots hold a token. A set has BITS slots, a large one eight times its size or up to double that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, n):
            out = []
            for s in sets:
                bits = np.zeros(max(BITS, 1 << (8 * len(s) - 1).bit_length()) if len(s) else BITS, np.uint8)
                bits[(s % np.uint64(len(bits))).astype(np.int64)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.record_batch({"id": b.column("doc_id"), "size": pa.array([len(s) for s in sets], pa.int64()), "bits": pa.array(out, pa.binary())})

    return map_marked(docs, run, "id long, size long, bits binary", marked).where("size > 0")


def folded(bits: bytes, length: int) -> np.ndarray:
    """A bitmap with so many bytes instead: slots a multiple of the new number apart become one."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, length // 8), axis=0)


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"id": b.column("id"), "size": b.column("size"), "bits": pa.array([folded(x, BITS // 8).tobytes() for x in b.column("bits").to_pylist()], pa.binary())})


def tokens_of(docs: DataFrame, n: int, marked: np.ndarray) -> DataFrame:
    """(id, tokens) of the rows that may be marked, in one pass and without a join; a row that isn't wanted meets no pair later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, n):
            yield pa.record_batch({"id": b.column("doc_id"), "tokens": _arrays(sets)})

    return map_marked(docs, run, "id long, tokens array<long>", marked).where("size(tokens) > 0")


def bounded(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar enough: left (a, size, x) and right (b, least, y) have bitmaps, and of a's slots those that b lacks each hold a token of a that b lacks. ``least`` is the size of b's set or, if b is a group, of its smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 2000) for i in range(0, big.num_rows, 2000)):
                lacking = []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    k = min(len(x), len(y))
                    lacking.append(int(np.bitwise_count(folded(x, k) & ~folded(y, k)).sum()))
                size, least = b.column("size").to_numpy(), b.column("least").to_numpy()
                other = np.maximum(least, least_overlap(size, percent))
                keep = size - np.array(lacking, np.int64) >= -(-percent * (size + other) // (100 + percent))
                yield b.select(["a", "b"]).filter(pa.array(keep))

    left, right = (maybe_marked(side, marks(pairs, key), key) for side, key in ((left, "a"), (right, "b")))  # bitmaps of no pair stay where they are
    return pairs.join(left, "a").join(right, "b").select("a", "b", "size", "least", "x", "y").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 200) for i in range(0, big.num_rows, 200)):
                keep = []
                for i in range(b.num_rows):
                    x, y = (b.column(c)[i].values.to_numpy() for c in ("x", "y"))
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    overlap = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * overlap >= percent * (len(both) - overlap))
                yield pa.record_batch({c: b.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    left, right = tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _enough(n, m, rest, other_rest, percent: int):
    """Whether sets of sizes n and m can be similar enough if they share nothing but what is left of each from a shared token on. That holds for the first shared token of every similar pair."""
    return (100 + percent) * F.least(rest, other_rest) >= percent * (n + m)


def _fit(n, m, percent: int):
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """n_shingles and component_id of every row of ``docs`` (doc_id, text; others are ignored).

    Two texts are linked if 100 * intersection >= percent * union of their sets of n-word shingles; a shorter text is one shingle. Text null or
    without a word: an empty set, linked with nothing. doc_id null: counted, but linked with nothing, component null. Rows that repeat a doc_id are one vertex.
    No rows: no rows.
    """
    src = id_and_text(docs)
    sets = written(sizes(src, n), "sizes", True)
    own = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    firsts = own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = written(own.join(firsts, "digest").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies", True)
    # a doc_id is a copy if all its sets are; texts that can't be copies stay where they are
    bitmap = marks(copies, "a")
    held = own.join(firsts, "digest", "left").where("rep IS NULL OR rep = doc_id").select("doc_id").distinct()
    src = src.where("doc_id IS NOT NULL")
    reps = written(maybe_marked(src, bitmap).select("doc_id").distinct().join(held, "doc_id"), "reps", True)
    texts = Texts(src, bitmap, reps)

    # prefix tokens, and of each the first class
    token = Window.partitionBy("token")
    prefix = prefixes(texts, n, percent, common_tokens(src, n)).select("id", "size", F.posexplode("prefix").alias("place", "token")).select("id", "size", "token", (F.col("size") - F.col("place")).alias("rest"))
    shared = prefix.select("*", F.min(F.struct("id", "size")).over(token).alias("least"), F.max("id").over(token).alias("last")).where("least.id != last")
    shared = written(shared.select("id", "size", "token", "rest", F.col("least.id").alias("least"), F.col("least.size").alias("least_size")), "shared", True)
    stars = shared.where((F.col("id") != F.col("least")) & _fit(F.col("size"), F.col("least_size"), percent)).select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    stars = written(stars, "stars", True)
    slots = written(bitmaps(src, n, marks(shared, "id")), "bitmaps", True)
    left, right = slots.select(F.col("id").alias("a"), "size", F.col("bits").alias("x")), slots.select(F.col("id").alias("b"), F.col("size").alias("least"), F.col("bits").alias("y"))
    stars = written(bounded(stars, left, right, percent).distinct(), "near", True)
    first = written(_compared(stars, src, n, percent), "first", True)
    groups = components(first)

    # the matrix: only tokens that more than one group shares make candidates; of two groups that with more members is the one to open.
    # A token's first class has met the others of it already, so two classes alone with a token, or without a group, need not meet there again
    groups = groups.join(groups.groupBy("component").agg(F.count("*").alias("members")), "component")
    member = shared.select("id", "size", "token", "rest").join(groups, "id", "left").select("id", "size", "token", "rest", F.coalesce("component", "id").alias("grp"), F.coalesce("members", F.lit(1)).alias("members"))
    several = member.select("*", F.min("grp").over(token).alias("g0"), F.max("grp").over(token).alias("g1"), F.count("*").over(token).alias("k"), F.min(F.struct("id", "size")).over(token).alias("least")).where("g0 != g1 AND k > 2")
    is_first = F.col("id") == F.col("least.id")
    several = written(several.select("id", "size", "token", "rest", "grp", "members", is_first.alias("first"), (~is_first & _fit(F.col("size"), F.col("least.size"), percent)).alias("met")), "several", True)
    matrix = several.groupBy("token", "grp", F.col("members").alias("of")).agg(F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.max("rest").alias("most_rest"), F.bool_or("first").alias("has_first"), F.bool_or("met").alias("has_met"))
    fitting = (100 * F.col("most_size") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("least_size"))
    fitting = fitting & _enough(F.col("size"), F.greatest("least_size", F.ceil(percent * F.col("size") / 100)), F.col("rest"), F.col("most_rest"), percent)
    larger = F.struct("of", "grp") > F.struct("members", "own")
    anew = (F.col("of") > 1) | ~(F.col("has_first") & F.col("met") | F.col("first") & F.col("has_met"))
    candidates = several.select("token", "id", "size", "rest", "members", "first", "met", F.col("grp").alias("own")).join(matrix, "token").where(larger & fitting & anew).select(F.col("id").alias("a"), F.col("grp").alias("b")).distinct()
    candidates = written(candidates, "candidates", True)
    unions = slots.mapInArrow(_smallest, "id long, size long, bits binary").join(groups, "id", "left").groupBy(F.coalesce("component", "id").alias("b")).agg(F.min("size").alias("least"), F.substring(F.bitmap_or_agg("bits"), 1, BITS // 8).alias("y"))
    opened = written(bounded(candidates, left, unions, percent).distinct(), "opened", True)
    others = several.select("token", F.col("grp").alias("b"), F.col("id").alias("other"), F.col("size").alias("other_size"), F.col("rest").alias("other_rest"))
    pairs = opened.join(several.select(F.col("id").alias("a"), "size", "token", "rest"), "a").join(others, ["token", "b"])
    pairs = pairs.where(_fit(F.col("size"), F.col("other_size"), percent) & _enough(F.col("size"), F.col("other_size"), F.col("rest"), F.col("other_rest"), percent))
    pairs = written(pairs.select(F.greatest("a", "other").alias("a"), F.least("a", "other").alias("b")).distinct(), "pairs", True)
    second = _compared(written(bounded(pairs, left, right, percent).distinct(), "close", True), src, n, percent)

    found = components(first.unionAll(second).unionAll(copies))
    return sets.join(found, sets["doc_id"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _compared(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that are similar enough, by the tokens of the texts they name."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return linked(pairs, written(tokens_of(docs, n, marks(ids, "id")), "tokens", True), percent)
