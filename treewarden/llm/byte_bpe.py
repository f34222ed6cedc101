"""Byte-level BPE from a rank file: encoding with offsets, and decoding of ids, whole or in parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .encoding import byte_characters, ranks_encoder, ranks_tokenizer, read_ranks


def offsets(text: str, path: str, pattern: str) -> list[tuple[int, int, int]]:
    """(id, begin, end) of each token in the text's UTF-8 bytes; a character split over tokens has its bytes shared out."""
    lengths = ranks_encoder(path, pattern).lengths
    ids = np.frombuffer(ranks_encoder(path, pattern).encode([text])[0], "<u4")
    ends = np.cumsum(lengths[ids])
    return list(zip(ids.tolist(), (ends - lengths[ids]).tolist(), ends.tolist(), strict=True))


def byte_table(path: str) -> list[bytes]:
    """Bytes of each id, by reversing the byte-to-character table on the vocabulary's strings."""
    from_char = {c: b for b, c in byte_characters().items()}
    vocabulary = ranks_tokenizer(path, r"\s+|\S+").get_vocab()
    table = [b""] * (1 + max(vocabulary.values()))
    for token, i in vocabulary.items():
        table[i] = bytes(map(from_char.__getitem__, token))
    return table


class Decoder:
    """Feeds on ids and gives text; bytes of a character that isn't complete wait for the next ids."""

    def __init__(self, table: list[bytes]):
        import codecs

        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)), last)


SCHEMA = "doc_id long, ids array<int>, begins array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    """doc_ids of a slice, each text's ids, and each id's first byte in the text."""
    encoder = ranks_encoder(path, pattern)
    for batch in slices(batches, most_bytes=10 << 20, holds="encoder"):
        ids = [np.frombuffer(x, "<u4") for x in encoder.encode(batch.column("text"))]
        yield batch.column("doc_id"), ids, ((np.cumsum(n) - n).astype(np.uint32) for n in (encoder.lengths[x] for x in ids))


def decoded(ids: np.ndarray, table: list[bytes], at_once: int = 8192) -> Iterator[str]:
    """The text of ids, part by part: a character that lies on both sides of a cut comes with the later part."""
    decoder = Decoder(table)
    for i in range(0, len(ids), at_once):
        yield decoder.feed(ids[i : i + at_once].tolist())
    yield decoder.feed([], last=True)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of each text, the first byte of each, and the text that they decode to. Text null or empty: no ids, an empty text; doc_id is carried as it is, null and repeated ones too; other columns are ignored. No shuffle."""

    def run(batches):
        table = byte_table(path)
        for keys, encoded, begins in _encoded(batches, path, pattern):
            yield pa.record_batch({"doc_id": keys, "ids": pa.array([x.astype(np.int32) for x in encoded], pa.list_(pa.int32())), "begins": pa.array([x.astype(np.int32) for x in begins], pa.list_(pa.int32())), "decoded": pa.array(["".join(decoded(x, table)) for x in encoded], pa.string())})

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_decode, but only counts and SHA-256 digests leave the task; offsets as little-endian unsigned 32-bit integers, one an id."""

    def run(batches):
        table = byte_table(path)
        decimal = [str(i) for i in range(len(table))]
        for keys, encoded, begins in _encoded(batches, path, pattern):
            texts = []
            for x in encoded:
                digest = hashlib.sha256()
                for part in decoded(x, table):
                    digest.update(part.encode())
                texts.append(digest.hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": keys,
                    "n_tokens": pa.array([len(x) for x in encoded], pa.int64()),
                    "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in encoded],
                    "decoded_sha256": texts,
                    "offsets_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in begins],
                }
            )

    return id_and_text(docs).mapInArrow(run, DIGESTS)
