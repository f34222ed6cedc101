"""Harmonic packing of tokenised documents into sequences.

A piece of length n belongs to class k = capacity // n: k pieces of a class fill one sequence, whichever they are, so every
task fills its bins alone and holds fewer than k open pieces of each class. A document is cut into pieces that are each
exactly capacity // k long, largest first, until at most ``uncut`` tokens are left; so full bins carry little padding. The
pieces left over in all tasks, a bounded number from each, are filled class by class in the same way over
groups of tasks, and what is then left over goes first-fit, longest first.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, written
from .encoding import json_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a task's own bins and of a group's bins can't meet: task or group number times ROOM, groups negative.
ROOM = 1 << 36


def cut(n: int, capacity: int, uncut: int) -> list[int]:
    """Lengths of a document's pieces, in the document's order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > uncut:
        out.append(piece := capacity // -(-capacity // n))
        n -= piece
    return [*out, n] if n else out


def first_fit(pieces: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Bins of piece numbers, from (length, number) pairs; longest first, each into the first bin that has room."""
    bins: list[list[int]] = []
    room: list[int] = []
    for length, number in sorted(pieces, key=lambda p: (-p[0], p[1])):
        for i, r in enumerate(room):
            if length <= r:
                break
        else:
            i = len(bins)
            bins.append([])
            room.append(capacity)
        bins[i].append(number)
        room[i] -= length
    return bins


def harmonic_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, uncut: int = 128, group: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Text null or empty: the end id alone is the document. doc_id null or repeated: packed like any other, a row of pieces
    each. Other columns are ignored. No documents: no pieces. The first step's rows are written, so that a lost
    executor can't deal the open pieces anew.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = json_encoder(tokenizer_path), TaskContext.get().partitionId()
        end, opened, sequence = np.array([end_id], "<u4").tobytes(), defaultdict(list), part * ROOM

        def rows(pieces: list[tuple], number: int | None) -> list[tuple]:
            out, at = [], 0
            for p in pieces:
                out.append((*p, number, at, part))
                at += p[2]
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*(x.split()[0] for x in SCHEMA.split(", ")), "part"])

        for batch in slices(batches, most_bytes=10 << 20, holds="encoder"):
            out: list[tuple] = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids, at = memoryview(ids + end), 0
                total = len(ids) // 4
                for n in cut(total, capacity, uncut):
                    k = capacity // n
                    opened[k].append((key, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total))
                    at += n
                    if len(opened[k]) == k:
                        out += rows(opened.pop(k), sequence)
                        sequence += 1
            yield batch_of(out)
        yield batch_of([r for pieces in opened.values() for r in rows(pieces, None)])

    filled = written(id_and_text(docs).mapInArrow(fill, f"{SCHEMA}, part long"), "pieces")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "doc_id", "start", "length", "ids_crc32"], ignore_index=True)
        number, bins, rest = -1 - int(pdf["part"].iloc[0] // group) * ROOM, [], []
        lengths = pdf["length"].to_numpy()
        for k, rows in pdf.groupby(capacity // pdf["length"]).indices.items():
            whole = len(rows) // k * k
            bins += [rows[i : i + k].tolist() for i in range(0, whole, k)]
            rest += [(int(lengths[i]), int(i)) for i in rows[whole:]]
        bins += first_fit(rest, capacity)
        sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for i, members in enumerate(bins):
            sequence[members] = number - i
            offset[members] = np.concatenate(([0], np.cumsum(lengths[members])[:-1]))
        return pdf.assign(sequence_id=sequence, offset=offset)[[x.split()[0] for x in SCHEMA.split(", ")]]

    open_pieces = filled.where("sequence_id IS NULL").groupBy(F.floor(F.col("part") / group).alias("g")).applyInPandas(gather, SCHEMA)
    return filled.where("sequence_id IS NOT NULL").drop("part").unionByName(open_pieces)
