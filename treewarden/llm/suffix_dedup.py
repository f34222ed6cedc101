"""Repeated passages, found by sorting the suffixes around anchors.

Two equal strings of ``length`` bytes choose the same anchors in themselves: the k-grams with the smallest hash among all k-grams of the
string. So (1) only anchors, about 7 in 100 positions, are sent out, as 32-bit hashes in buckets, to learn which are in two or more
documents; (2) those alone go back to their documents and bring along the bytes around them; (3) in each bucket of anchors rows with the same bytes around them
become one, by hashes that are verified, and the suffixes that begin at the offsets around the others are sorted, each string by its own anchor,
by their bytes, eight at a time; (4) spans go back to the documents.

Hot anchors, told beforehand from a sample of documents, don't meet by anchor: they are dealt over buckets by document in (1), and in (3) every string around
them is dealt by itself, from each slice only in its smallest document there, and by slice first, and only the smallest documents of each part meet in a second round. A hot anchor that the sample
misses is handled like any other; results are the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INVERSE, give_back, id_and_text, map_marked, marks, maybe_marked, mixed, powers, prefix_hashes, slices, steady, utf8, written

GRAM = 24


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over every w neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(x) - w + 1], out[w - have :]) if have < w else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``data`` (texts back to back, each up to its end) of the anchors of all strings of ``length`` bytes within a text, and the anchors' 64-bit hashes."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p = prefix_hashes(data)
    grams = (p[GRAM:] - p[:-GRAM]) * powers(n - GRAM + 1, INVERSE)
    grams = mixed(grams)
    order = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = slide(order, w, np.minimum)
    begins = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, np.int32)
    whole = ends - begins >= length
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    most = slide(np.concatenate((np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32))), w, np.maximum)
    at = np.flatnonzero(most == order)
    return at, grams[at]


def sort_suffixes(data: np.ndarray, starts: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes (first ``length`` bytes, eight at least) in which those of one key stand together and sorted, and whether each equals its predecessor.

    A stable sort by eight bytes at a time, the last eight first and the keys at the end; one such column is held at a time.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    offsets = [*range(0, length - 8, 8), length - 8]  # the last may overlap the one before it

    def column(at: int) -> np.ndarray:
        return eights[starts + at].view(">u8").ravel().astype(np.uint64)

    order = np.arange(n)
    for at in reversed(offsets):
        order = order[np.argsort(column(at)[order], kind="stable")]
    order = order[np.argsort(keys[order], kind="stable")]
    same = np.ones(n, bool)
    same[0] = False
    for x in (keys, *map(column, offsets)):
        sorted_x = x[order]
        same[1:] &= sorted_x[1:] == sorted_x[:-1]
    return order, same


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of a matrix of bytes, row by row."""
    out, weights = np.zeros(len(rows), np.uint64), powers(rows.shape[1])
    for j in range(rows.shape[1]):
        out += (rows[:, j].astype(np.uint64) + np.uint64(1)) * weights[j]
    return mixed(out)


def alike(rows: np.ndarray) -> np.ndarray:
    """Numbers of the rows of bytes, the same for equal rows: rows of one hash are held against the first of them byte by byte."""
    _, first, out = np.unique(row_hashes(rows), return_index=True, return_inverse=True)
    for at in range(0, len(rows), 50_000):
        if (rows[at : at + 50_000] != rows[first[out[at : at + 50_000]]]).any():  # different rows with one hash
            return classes(rows, np.zeros(len(rows), np.int64), rows.shape[1])
    return out


def classes(rows: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the rows of bytes, the same for those with the same first ``length`` bytes, by sorting them as suffixes. Equal rows must have equal keys."""
    order, same = sort_suffixes(np.ascontiguousarray(rows).ravel(), np.arange(len(rows)) * rows.shape[1], keys, length)
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def least_of(kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each row the smallest doc of its kind."""
    least = np.full(kind.max() + 1 if len(kind) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    return least[kind]


def in_many(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a hash that rows of two docs or more have."""
    if not len(hashes):
        return np.empty(0, bool)
    order = np.argsort(hashes)
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    out = np.empty(len(h), bool)
    out[order] = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(first, append=len(h)))
    return out


def led(around: np.ndarray, length: int) -> np.ndarray:
    """Of each anchor's surroundings and each offset, whether the string of ``length`` bytes that begins so many bytes before the anchor has no gram of a smaller hash.

    Every string is so dealt by its own anchor only, the same one wherever it stands.
    """
    out, n = length - GRAM, around.shape[1]
    flags = np.empty((len(around), out + 1), bool)
    for at in range(0, len(around), 4096):
        some = around[at : at + 4096]
        p = np.zeros((len(some), n + 1), np.uint64)
        np.cumsum((some.astype(np.uint64) + np.uint64(1)) * powers(n), axis=1, out=p[:, 1:])
        order = (mixed((p[:, GRAM:] - p[:, :-GRAM]) * powers(n - GRAM + 1, INVERSE)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = np.lib.stride_tricks.sliding_window_view(order, out + 1, axis=1).min(2)
        flags[at : at + 4096] = (least == order[:, out : out + 1])[:, ::-1]
    return flags


def strings_around(doc: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings that anchors with these surroundings deal: their anchor's row, how many bytes before it they begin, their bytes, and whether a smaller doc among these has them too."""
    out, width, offset = length - GRAM, around.shape[1], np.arange(length - GRAM + 1)
    row, a = np.nonzero((offset <= left[:, None]) & (out - offset <= right[:, None]) & led(around, length))
    if not len(row):
        return row, a, np.empty((0, length), np.uint8), np.empty(0, bool)
    strings = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(around).ravel(), length)[row * width + out - a]
    return row, a, strings, doc[row] > least_of(alike(strings), doc[row])


def settle(doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, begin, end) of strings that also start in a document of a smaller doc_id, among anchors with what is around them.

    around: a row of 2 * length - GRAM bytes per anchor, the anchor in its middle; left and right: how many bytes on each side are the document's.
    """
    out = length - GRAM
    width = 2 * length - GRAM
    if not len(doc):
        return doc, pos, pos
    grams = row_hashes(around[:, out : out + GRAM])
    _, whole = np.unique(alike(around) * (out + 1) ** 2 + left * (out + 1) + right, return_inverse=True)
    covered = doc > least_of(whole, doc)
    longest, shortest = np.minimum(left, out), np.maximum(0, out - right)
    spans = [(doc[covered], (pos - longest)[covered], (pos - shortest + length)[covered])]
    # of each kind of surroundings one row of its smallest doc stands for all of them
    mine = np.flatnonzero(~covered)
    chosen = mine[np.unique(whole[mine], return_index=True)[1]]
    _, gram, many = np.unique(grams[chosen], return_inverse=True, return_counts=True)
    chosen, gram = chosen[many[gram] > 1], gram[many[gram] > 1]
    by_gram = np.argsort(gram, kind="stable")
    chosen, gram = chosen[by_gram], gram[by_gram]
    kind = np.full(whole.max() + 1, -1)
    kind[whole[chosen]] = np.arange(len(chosen))
    flags = np.zeros((len(chosen), out + 1), bool)
    ends = 1 + np.flatnonzero(np.concatenate((gram[1:] != gram[:-1], [True]))) if len(chosen) else []
    at = 0
    for end in ends:  # some thousand rows at a time, all of a gram together
        if end - at < 4000 and end < len(chosen):
            continue
        flags[at:end] = _repeated(around[chosen[at:end]], doc[chosen[at:end]], left[chosen[at:end]], right[chosen[at:end]], gram[at:end], length)
        at = end
    # the same flags for all rows of the same doc with the same surroundings
    rows = mine[kind[whole[mine]] >= 0]
    r, a = np.nonzero(flags[kind[whole[rows]]])
    spans.append((doc[rows][r], pos[rows][r] - a, pos[rows][r] - a + length))
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def _repeated(around: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, gram: np.ndarray, length: int) -> np.ndarray:
    """Of each row and offset, whether the string that begins so many bytes before the anchor also occurs in a row of a smaller doc."""
    out, width = length - GRAM, around.shape[1]
    flags = np.zeros((len(doc), out + 1), bool)
    if len(doc):
        offset = np.arange(out + 1)
        valid = (offset <= left[:, None]) & (out - offset <= right[:, None]) & led(around, length)
        row, a = np.nonzero(valid)
        data, starts = np.ascontiguousarray(around).ravel(), row * width + out - a
        # a string whose hash only one doc has is not repeated; the sort tells of the others
        p = prefix_hashes(data)
        some = in_many((p[starts + length] - p[starts]) * powers(len(p), INVERSE)[starts], doc[row])
        row, a, starts = row[some], a[some], starts[some]
        order, same = sort_suffixes(data, starts, gram[row] * (out + 1) + a, length)
        owner = doc[row[order]]
        hit = order[owner > least_of(np.cumsum(~same) - 1, owner)]
        flags[row[hit], a[hit]] = True
    return flags


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap become one."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], begin[at], np.concatenate((reach[at[1:] - 1], reach[-1:]))


def _planes(x: np.ndarray) -> bytes:
    """A column's bytes with the first bytes of all its numbers first, and so on: the high bytes of small numbers compress to nothing."""
    return x.tobytes() if x.itemsize == 1 else np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _bucket_rows(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that occurs; each column's values of a bucket as bytes, numbers as _planes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.empty(0, np.int64)
    last = np.concatenate((first[1:], [len(b)])) if len(b) else first
    sorted_columns = {k: v[order] for k, v in columns.items()}
    return pa.record_batch({"bucket": pa.array(b[first], pa.int32()), **{k: pa.array([_planes(v[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()) for k, v in sorted_columns.items()}})


def _steps(bucket: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Differences to the value before in the same bucket, which compress better; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    b, v = bucket[order], values[order]
    steps = np.diff(v, prepend=v[:1] * 0)
    first = np.concatenate(([True], b[1:] != b[:-1]))
    steps[first] = v[first]
    out = np.empty_like(steps)
    out[order] = steps
    return out


def _numbers(planes: bytes, dtype) -> np.ndarray:
    """What _planes packed."""
    size = np.dtype(dtype).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, len(planes) // size).T.copy().view(dtype).ravel() if size > 1 else np.frombuffer(planes, dtype)


def _packed(raw: bytes) -> bytes:
    """Bytes of text, which the shuffle's own codec makes little smaller."""
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed, size, asbytes=True), np.uint8)


def _summed(rows: pa.Table, column: str, dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *[np.cumsum(_numbers(x, dtype), dtype=dtype) for x in rows[column].to_pylist()]])


def _joined(rows: pa.Table, column: str, dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *[_numbers(x, dtype) for x in rows[column].to_pylist()]])


def hot_anchors(src: DataFrame, length: int, hot: int) -> np.ndarray:
    """Hashes, in order, of the anchors that about ``hot`` places or more have, as a sample of documents tells; a million at most.

    They only decide where rows meet, never whether something is removed.
    """
    one_in = max(1, hot // 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most_bytes=1 << 20):
            texts = utf8(b.column("text"))
            grams, n = np.unique(anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), length)[1], return_counts=True)
            yield pa.record_batch({"gram": grams.view(np.int64), "n": n})

    sample = src.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    counts = sample.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, hot // (2 * one_in)))
    return np.sort(counts.orderBy(F.desc("n"), "gram").limit(1_000_000).toArrow()["gram"].to_numpy().view(np.uint64))


def _is_in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``x`` the sorted array ``of`` holds."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def repeated_spans(docs: DataFrame, length: int = 50, hot: int = 20_000, slices_at_once: int = 16_384) -> DataFrame:
    """(doc_id, spans: sorted disjoint array of begin, end) of the documents with bytes to remove."""
    src = id_and_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = max(1, src.rdd.getNumPartitions())
    buckets = 1 << max(4, math.ceil(math.log2(16 * parts)))
    # a slice of about 1 MB sends a string of a hot anchor once; so many slices meet in one part, and the parts in a second round
    salts = max(1, math.ceil(128 * parts / slices_at_once))
    out, width = length - GRAM, 2 * length - GRAM
    held = src.sparkSession.sparkContext.broadcast(hot_anchors(src, length, hot))  # a million at most

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        """Anchors have small hashes, so buckets are made from these mixed anew."""
        return (mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of about a megabyte at a time, one row a bucket for every 16 MB or so."""
        steady()
        found, size = [], 0

        def dealt() -> pa.RecordBatch:
            grams, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            bucket = np.where(_is_in(grams, held.value), buckets + bucket_of(doc.view(np.uint64)), bucket_of(grams))
            return _bucket_rows(bucket, {"gram": (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), "doc": _steps(bucket, doc), "pos": _steps(bucket, pos)})

        for b in slices(batches, most_bytes=1 << 20):
            texts = utf8(b.column("text"))
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            at, grams = anchors(data, ends, length)
            row = np.searchsorted(ends, at, side="right")
            found.append((grams, b.column("doc_id").to_numpy()[row], (at - np.concatenate(([0], ends))[row]).astype(np.uint32)))
            size += len(data)
            if size > 16 << 20:
                yield dealt()
                size = 0
        if found:
            yield dealt()
        give_back()

    def share(rows: pa.Table) -> pa.Table:
        gram, doc, pos = _joined(rows, "gram", np.uint32), _summed(rows, "doc", np.int64), _summed(rows, "pos", np.uint32)
        if rows["bucket"][0].as_py() >= buckets:
            return pa.table({"doc_id": doc, "at": pos.astype(np.int64) * 2 + 1})
        order = np.argsort(gram, kind="stable")
        gram, doc, pos = gram[order], doc[order], pos[order]
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = np.repeat(many, np.diff(np.concatenate((first, [len(gram)]))))
        return pa.table({"doc_id": doc[keep], "at": pos[keep].astype(np.int64) * 2})

    sent = src.mapInArrow(send, "bucket int, gram binary, doc binary, pos binary")
    shared = written(sent.groupBy("bucket").applyInArrow(share, "doc_id long, at long"), "shared", drop_shuffles=True)
    at = shared.groupBy("doc_id").agg(F.collect_list("at").alias("at"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Surroundings of shared anchors by anchor bucket, of hot ones string by string; what is settled among these rows rides along as spans."""
        held_rows, size = [], 0

        def dealt() -> pa.RecordBatch:
            bucket, doc, pos, left, right, around, *spans = (np.concatenate(x) for x in zip(*held_rows, strict=True))
            held_rows.clear()
            rows = _bucket_rows(bucket, {"doc": doc, "pos": pos, "left": left, "right": right, "around": around})
            rows = rows.set_column(rows.schema.get_field_index("around"), "around", pa.array([_packed(x) for x in rows["around"].to_pylist()], pa.binary()))
            riding = int(mixed(doc[:1].view(np.uint64))[0] % np.uint64(rows.num_rows))
            ride = lambda x: [_planes(x) if i == riding else b"" for i in range(rows.num_rows)]
            return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(ride(x), pa.binary()) for x in spans)], [*rows.schema.names, "span_doc", "span_begin", "span_end"])

        for b in slices(batches, most_bytes=1 << 20):
            texts, sizes = utf8(b.column("text")), b.column("at").value_lengths().to_numpy()
            lengths = np.array([len(t) for t in texts])
            gap = bytes(out)
            data, begins = np.frombuffer(gap + gap.join(texts) + gap, np.uint8), out + np.cumsum(lengths + out) - lengths - out
            code, row = b.column("at").flatten().to_numpy(), np.repeat(np.arange(len(texts)), sizes)
            pos, is_hot, doc = code >> 1, (code & 1).astype(bool), b.column("doc_id").to_numpy()[row]
            there = pos + GRAM <= lengths[row]  # another row with this doc_id can be shorter
            pos, is_hot, doc, row = pos[there], is_hot[there], doc[there], row[there]
            around = np.lib.stride_tricks.sliding_window_view(data, width)[begins[row] + pos - out]
            left, right = np.minimum(pos, out), np.minimum(lengths[row] - pos - GRAM, out)
            fits = left + right >= out
            doc, pos, left, right, around, is_hot = (x[fits] for x in (doc, pos, left, right, around, is_hot))
            if not len(doc):
                continue
            # equal surroundings here: only the smallest doc's go on, the others are settled
            gram = row_hashes(around[:, out : out + GRAM])
            _, kind = np.unique(alike(around) * (out + 1) ** 2 + left * (out + 1) + right, return_inverse=True)
            over = doc > least_of(kind, doc)
            settled = doc[over], (pos - np.minimum(left, out))[over], (pos - np.maximum(0, out - right) + length)[over]
            doc, pos, left, right, around, is_hot, gram = (x[~over] for x in (doc, pos, left, right, around, is_hot, gram))
            # a hot anchor: each string of the wanted length around it is dealt by itself, with nothing around
            row, a, strings, again = strings_around(doc[is_hot], left[is_hot], right[is_hot], around[is_hot], length)
            h = np.flatnonzero(is_hot)[row]
            # nor does a string go on that also stands in other surroundings of a smaller doc here
            spans = merged(*(np.concatenate(x) for x in zip(settled, (doc[h][again], (pos[h] - a)[again], (pos[h] - a + length)[again]), strict=True)))
            h, a = h[~again], a[~again]
            strings = np.pad(strings[~again], ((0, 0), (0, width - length)))
            cold, none = ~is_hot, np.zeros(len(h), np.uint8)
            salt = np.uint64(int(mixed(doc[:1].view(np.uint64))[0]) % salts)
            bucket = np.concatenate((bucket_of(gram[cold]), buckets + bucket_of(row_hashes(strings[:, :length]) ^ mixed(np.full(1, salt)))))
            if len(bucket):
                held_rows.append((bucket, np.concatenate((doc[cold], doc[h])), np.concatenate((pos[cold], pos[h] - a)), np.concatenate((left[cold].astype(np.uint8), none)), np.concatenate((right[cold].astype(np.uint8), none)), np.concatenate((around[cold], strings)), *spans))
            elif len(spans[0]):
                held_rows.append((np.zeros(1, np.int64), spans[0][:1], spans[1][:1], np.zeros(1, np.uint8), np.zeros(1, np.uint8), np.zeros((1, width), np.uint8), *spans))
            size += int(lengths.sum())
            if held_rows and size > 4 << 20:
                yield dealt()
                size = 0
        if held_rows:
            yield dealt()
        give_back()

    schema = "bucket int, doc binary, pos binary, left binary, right binary, around binary, span_doc binary, span_begin binary, span_end binary"
    near = maybe_marked(src, marks(shared.select("doc_id"), "doc_id"))
    surrounded = near.join(at, "doc_id").select("doc_id", "text", "at").mapInArrow(surround, schema)

    def reduce(rows: pa.Table) -> pa.Table:
        """Spans of a bucket; of hot strings also the smallest doc's rows, which go on to the second round."""
        steady()
        give_back()
        doc, pos = _joined(rows, "doc", np.int64), _joined(rows, "pos", np.int64)
        around = np.concatenate([_unpack(x, width * len(left)) for x, left in zip(rows["around"].to_pylist(), rows["left"].to_pylist(), strict=True)]).reshape(-1, width)
        on = pa.table({"doc_id": pa.array([], pa.int64()), "begin": pa.array([], pa.int64()), "end": pa.array([], pa.int64()), "string": pa.array([], pa.binary()), "bucket": pa.array([], pa.int32())})
        if rows["bucket"][0].as_py() >= buckets:
            keys = row_hashes(around[:, :length])
            over = doc > least_of(classes(around, keys, length), doc)
            found = doc[over], pos[over], pos[over] + length
            doc, pos, around, keys = (x[~over] if salts > 1 else x[:0] for x in (doc, pos, around, keys))
            on = pa.table({"doc_id": doc, "begin": pos, "end": pos + length, "string": pa.array([x.tobytes() for x in around[:, :length]], pa.binary()), "bucket": bucket_of(keys).astype(np.int32)})
        else:
            found = settle(doc, pos, _joined(rows, "left", np.uint8).astype(np.int64), _joined(rows, "right", np.uint8).astype(np.int64), around, length)
        settled = (_joined(rows, c, np.int64) for c in ("span_doc", "span_begin", "span_end"))
        doc, begin, end = merged(*(np.concatenate(x) for x in zip(found, settled, strict=True)))
        return pa.concat_tables([pa.table({"doc_id": doc, "begin": begin, "end": end, "string": pa.nulls(len(doc), pa.binary()), "bucket": pa.nulls(len(doc), pa.int32())}), on])

    def second(rows: pa.Table) -> pa.Table:
        doc, begin = rows["doc_id"].to_numpy(), rows["begin"].to_numpy()
        strings = np.frombuffer(b"".join(rows["string"].to_pylist()), np.uint8).reshape(-1, length)
        over = doc > least_of(classes(strings, row_hashes(strings), length), doc)
        return pa.table(dict(zip(("doc_id", "begin", "end"), merged(doc[over], begin[over], begin[over] + length), strict=True)))

    first = surrounded.groupBy("bucket").applyInArrow(reduce, "doc_id long, begin long, end long, string binary, bucket int")
    twice = len(held.value) > 0 and salts > 1
    first = written(first, "first", drop_shuffles=True) if twice else first
    again = first.where("string IS NOT NULL").groupBy("bucket").applyInArrow(second, "doc_id long, begin long, end long")
    spans = first.where("string IS NULL").select("doc_id", "begin", "end")
    spans = spans.unionAll(again) if twice else spans
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    kept, at, n, runs = [], 0, 0, 0
    for begin, end in sorted(spans):
        begin = max(begin, at) if runs else begin
        if runs == 0 or begin > at:
            runs += 1
            kept.append(text[at:begin])
        if end > at:
            n += end - max(begin, at)
            at = end
    kept.append(text[at:])
    return b"".join(kept), n, runs


def _with_spans(docs: DataFrame, length: int, run, schema) -> DataFrame:
    """mapInArrow with ``run`` over slices of ``docs`` with their spans; documents without any don't go through a shuffle."""
    spans = written(repeated_spans(docs, length), "spans", drop_shuffles=True)
    bitmap, none = marks(spans, "doc_id"), F.lit(None).cast(spans.schema["spans"].dataType)
    # the columns ride as one struct, so that none of their names can clash
    whole = docs.select("doc_id", F.struct("*").alias("row"))
    joined = maybe_marked(whole, bitmap).join(spans, "doc_id", "left").select("row", "spans")
    split = lambda batches: run(_unpacked(batches))
    return joined.mapInArrow(split, schema).unionAll(map_marked(whole.withColumn("spans", none), split, schema, bitmap, False))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A slice of the rows that were packed, and their spans."""
    for big in batches:
        rows = pa.RecordBatch.from_struct_array(big.column("row"))
        at = 0
        for b in slices([rows]):
            yield b, big.column("spans").slice(at, b.num_rows).to_pylist()
            at += b.num_rows


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, for removal of every byte within a ``length``-byte string that also starts in a document with a smaller doc_id.

    Text null: no bytes. doc_id null: takes no part and keeps all. Rows that repeat a doc_id are one document, no reason to remove anything from each other; a place that goes in one of
    them goes in all of them that reach so far. No rows: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[tuple[pa.RecordBatch, list]]) -> Iterator[pa.RecordBatch]:
        for b, found in batches:
            out = []
            for text, spans in zip(utf8(b.column("text")), found, strict=True):
                kept, n, runs = removed(text, [(s["begin"], min(s["end"], len(text))) for s in spans or [] if s["begin"] < len(text)])
                out.append((len(text), n, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.record_batch({"doc_id": b.column("doc_id"), **{k: pa.array(v) for k, v in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, strict=True)}})

    return _with_spans(id_and_text(docs), length, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with its own columns, ``text`` less the repeated bytes (a character that loses some of its bytes goes whole), ``n_chars``, if there, counted anew. Null stays null."""
    schema = docs.schema

    def run(batches: Iterator[tuple[pa.RecordBatch, list]]) -> Iterator[pa.RecordBatch]:
        for b, found in batches:
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), found, strict=True):
                texts.append(text if text is None or not spans else removed(text.encode(), [(s["begin"], s["end"]) for s in spans])[0].decode("utf-8", "ignore"))
            columns = {f.name: b.column(f.name) for f in schema}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.record_batch(columns)

    return _with_spans(docs, length, run, schema)
