"""Token-id shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents (ascending doc_id) as one array and two Elias-Fano sequences: the
document ids and the document ends. Elias-Fano keeps the low bits of each value packed and the high bits in unary,
about 2 + log2(range / count) bits a value; the positions of every 256th one bit make select() fast. No table of
64-bit offsets is kept.

File: 8 bytes magic, 4 bytes header length, header (JSON: sizes and counts), then the arrays in the header's order,
all little-endian.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, shared_dir, slices, written
from .encoding import json_encoder

MAGIC = b"TWTOKEN1"
SAMPLE = 256


class EliasFano:
    """A sequence of non-negative integers that never falls."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value number ``i``: goes from the nearest sample to the i-th one bit, byte by byte."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        begin, value = i * self.low_bits, 0
        for k in range(self.low_bits):
            b = begin + k
            value |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return value

    def block(self, k: int) -> np.ndarray:
        """Values number SAMPLE * k and on, SAMPLE of them or up to the end: a select of the first by its sample and of the others from there."""
        i = np.arange(SAMPLE * k, min(self.count, SAMPLE * (k + 1)))
        begin = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        ones = 8 * (begin // 8) + np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-stop // 8)], bitorder="little"))
        ones = ones[ones >= begin][: len(i)]
        at = i[:1] * self.low_bits if len(i) else i
        first, size = int(at[0]) if len(at) else 0, len(i) * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-(first + size) // 8)], bitorder="little")[first % 8 :][:size].reshape(len(i), self.low_bits).astype(np.int64)
        return ((ones - i) << self.low_bits) + bits @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def blocks(self) -> Iterator[np.ndarray]:
        return map(self.block, range(len(self.samples)))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.samples]

    def head(self) -> dict:
        return {"count": self.count, "low_bits": self.low_bits, "bytes": [int(x.nbytes) for x in self.arrays()]}

    @classmethod
    def read(cls, head: dict, take) -> EliasFano:
        low, high, samples = (take(n) for n in head["bytes"])
        return cls(head["count"], head["low_bits"], np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4"))


def shard_bytes(doc_ids: np.ndarray, nulls: int, lengths: np.ndarray, ids: bytes) -> list[bytes]:
    """The parts of a shard. ``nulls``: so many documents at its front have no doc_id; ``ids``: little-endian uint32."""
    base = int(doc_ids[nulls]) if len(doc_ids) > nulls else 0
    keys = EliasFano.of(doc_ids[nulls:] - base)
    ends = EliasFano.of(np.cumsum(lengths))
    array = np.frombuffer(ids, "<u4")
    width = 2 if not len(array) or int(array.max()) < 1 << 16 else 4
    head = json.dumps({"nulls": nulls, "base": base, "width": width, "n_ids": len(array), "keys": keys.head(), "ends": ends.head()}).encode()
    return [MAGIC, len(head).to_bytes(4, "little"), head, *[x.tobytes() for x in (*keys.arrays(), *ends.arrays(), array.astype(f"<u{width}"))]]


class Shard:
    """A shard opened from its bytes: doc_id(i), span(i), ids(i); ids stay in the file's buffer until asked for."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(view[8:12], "little")
        head, at = json.loads(bytes(view[12 : 12 + size])), 12 + size

        def take(n: int):
            nonlocal at
            at += n
            return view[at - n : at]

        self.nulls, self.base = head["nulls"], head["base"]
        self.keys, self.ends = EliasFano.read(head["keys"], take), EliasFano.read(head["ends"], take)
        self.array = np.frombuffer(take(head["n_ids"] * head["width"]), f"<u{head['width']}")

    def __len__(self) -> int:
        return self.ends.count

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.keys.select(i - self.nulls)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        begin, end = self.span(i)
        return self.array[begin:end].astype("<u4")


MANIFEST = "part int, shard int, path string, n_docs long, n_ids long"


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0, ids_per_shard: int = 4_000_000, path: str | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text; other columns are ignored) and writes shards in ascending doc_id order; returns the manifest with each shard's first position.

    Text null or empty: just the end id. doc_id null: first of all, in any order among themselves; equal doc_ids: side by
    side. No documents: an empty manifest. The text is dealt by range of doc_id once; a task holds one
    shard's ids (a document longer than ``ids_per_shard`` makes a longer shard). A repeated task writes new files,
    and the manifest, committed by Spark, names those of the attempt that counts.
    """
    folder = path or shared_dir(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder, part, shard = json_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        keys: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal keys, held, size, shard
            name = f"{root}/{part:06d}-{shard:05d}-{uuid.uuid4().hex}.tok"
            nulls = sum(k is None for k in keys)
            with store.open_output_stream(name) as out:
                for x in shard_bytes(np.array([0 if k is None else k for k in keys], np.int64), nulls, np.array([len(x) // 4 for x in held]), b"".join(held)):
                    out.write(x)
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [len(keys)], "n_ids": [size]})
            keys, held, size, shard = [], [], 0, shard + 1
            return row

        for batch in slices(batches, most_bytes=10 << 20, holds="encoder"):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                if held and size + len(ids) // 4 + 1 > ids_per_shard:
                    yield flush()
                keys.append(key)
                held.append(ids + end)
                size += len(ids) // 4 + 1
        if held:
            yield flush()

    ranged = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = written(ranged.mapInArrow(write, MANIFEST), "manifest")
    # one narrow row a shard of millions of ids: a running sum in one task
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    scheme = pafs.FileSystem.from_uri(folder)[0].type_name
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("store", F.lit("file:///" if scheme == "local" else folder))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_store(manifest: DataFrame) -> DataFrame:
    """One row per stored document, from the shards' files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Places come from the select structures, some documents at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = pafs.FileSystem.from_uri(row["store"])
                with store.open_input_file(row["path"]) as f:
                    shard = Shard(f.read())
                before, keys, held = 0, shard.keys.blocks(), [None] * shard.nulls
                for ends in shard.ends.blocks():  # SAMPLE documents at a time, no table of all ends
                    starts = np.concatenate(([before], ends[:-1]))
                    before = int(ends[-1])
                    while len(held) < len(ends):
                        held += (shard.base + next(keys)).tolist()
                    crcs = [zlib.crc32(shard.array[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.record_batch({"doc_id": pa.array(held[: len(ends)], pa.int64()), "start": pa.array(row["first"] + starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
                    held = held[len(ends) :]

    n = max(1, min(10_000, manifest.count()))
    return manifest.repartition(n, "path").mapInArrow(read, READ)


