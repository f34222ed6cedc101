"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model of its words, and the document's is
their noisy-or, 1 - prod(1 - p). The model is fitted to document labels only: the gradient of the noisy-or shares a
label out to the sentences that can explain it, so the fitted sentence scores also say where a document offends.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, give_back, id_and_text, slices, written

SLOTS = 1 << 20
_SENTENCE = re.compile(r"[.!?\n]+")
_EDGES = "\"'()[]{}<>,;:-–—¡¿!?.*#$%&|"


class WordSlots(dict):
    """Slots of a word, in lower case and without marks at its ends: itself and its first four and five letters, as inflected words share stems. Up to 50,000 words are remembered."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        plain = word.lower().strip(_EDGES)
        parts = ([plain, *(f"{plain[:n]}-" for n in (4, 5) if len(plain) >= n)]) if plain else []
        slots = tuple(xxhash.xxh64_intdigest(p.encode("utf-8", "replace")) % SLOTS for p in parts)
        if len(self) < 50_000:
            self[word] = slots
        return slots


def sentences(text: str) -> list[tuple[int, str]]:
    """(begin, sentence) of each sentence with something in it."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, text[at : m.start()]))
        at = m.end()
    if text[at:].strip():
        out.append((at, text[at:]))
    return out


class Model:
    """bias and a weight per slot; score(sentences) gives probabilities."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def sentence_scores(self, texts: list[str], slots: WordSlots) -> np.ndarray:
        """A sentence's logit is the bias and the sum of its words' slots' weights, each slot once."""
        found = [set(chain.from_iterable(map(slots.__getitem__, t.split()))) for t in texts]
        sizes = np.array([len(x) for x in found])
        flat = np.fromiter((s for x in found for s in x), np.int64, sizes.sum())
        z = np.bincount(np.repeat(np.arange(len(texts)), sizes), self.weights[flat], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def bag(text: str, slots: WordSlots) -> tuple[np.ndarray, np.ndarray]:
    """A text as a bag: the slots of its sentences one after another, each once in a sentence, and how many each sentence has."""
    found = [set(chain.from_iterable(map(slots.__getitem__, s.split()))) for _, s in sentences(text)]
    sizes = np.array([len(x) for x in found], np.int32)
    return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Sums of values[at] over the runs that begin at ``starts``; only ``step`` or so of the values are gathered at a time."""
    out, first = np.zeros(len(starts)), 0
    ends = np.append(starts[1:], len(at))
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, side="right")))
        out[first:last] = np.add.reduceat(values[at[starts[first] : ends[last - 1]]], starts[first:last] - starts[first])
        first = last
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 150, rate: float = 0.2, l1: float = 1.5e-4, least_docs: int = 6) -> Model:
    """Full-batch Adam on the bags' log loss with a penalty on absolute weights; slots of fewer than ``least_docs`` documents keep no weight.

    Words are held as two arrays of 32-bit numbers, by sentence and by slot, so what a round needs beside them is a few numbers a sentence and a slot.
    """
    y, weights = np.array(labels, float), np.zeros(SLOTS, np.float32)
    sizes = np.concatenate([np.empty(0, np.int32), *(n for _, n in bags)])
    if not len(sizes) or y.min() == y.max():
        return Model(-6.0 if not len(y) or y.max() == 0 else 0.0, weights)
    docs = np.zeros(SLOTS, np.int32)
    for words, _ in bags:
        docs[np.unique(words)] += 1
    common = docs >= least_docs
    kept = np.flatnonzero(common)
    place = np.cumsum(common, dtype=np.int32) - 1
    words = np.concatenate([np.empty(0, np.int32), *(place[w[common[w]]] for w, _ in bags)])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(n) for _, n in bags])
    # how many common slots each sentence has; sentences without one have the bias alone
    left = np.concatenate([np.empty(0, np.int32), *(np.bincount(np.repeat(np.arange(len(n)), n), common[w], len(n)).astype(np.int32) for w, n in bags)])
    full = np.flatnonzero(left)
    starts = np.cumsum(left[full], dtype=np.int64) - left[full]
    order = np.argsort(words, kind="stable").astype(np.int32)
    of = np.repeat(full.astype(np.int32), left[full])[order]
    counts = np.bincount(words, minlength=len(kept))
    del order
    word_starts, doc_starts = np.cumsum(counts) - counts, np.flatnonzero(np.diff(doc, prepend=-1))
    in_doc = doc[doc_starts]
    w, bias, m, v, mb, vb = np.zeros(len(kept)), -4.0, np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.full(len(left), bias)
        z[full] += _sums(w, words, starts)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        whole = np.zeros(len(y))
        whole[in_doc] = np.add.reduceat(np.log1p(-p), doc_starts)
        whole = np.clip(-np.expm1(whole), 1e-9, 1 - 1e-9)
        g = np.where(y[doc] > 0, -(1 - whole[doc]) / whole[doc], 1.0) * p / len(y)
        gw = (_sums(g, of, word_starts) if len(kept) else np.zeros(0)) + l1 * np.tanh(10 * w)
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate / 3 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights[kept] = w
    return Model(float(bias), weights)


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 6_000, most_chars: int = 16_000_000) -> Model:
    """Fits on a bounded sample of the labelled rows: those with the smallest hashes of doc_id, ``most_docs`` at most and about ``most_chars`` characters together.

    Texts become bags of slot numbers in tasks; the driver gets these, four bytes a slot, and no text. Rows with a null label,
    doc_id or text teach nothing; of a doc_id's several labels the largest counts, of its several texts each.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Model(-6.0, np.zeros(SLOTS, np.float32))
    chosen = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).where(F.col("h") < F.lit(min(1.0, most_docs / n) * (1 << 30)))
    sample = id_and_text(docs).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "text", "toxic")  # at most about most_docs rows of numbers
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    part = F.lit(min(1.0, most_docs / n) * min(1.0, most_chars / max(1, chars)) * (1 << 30))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots()
        for b in slices(batches, holds="slots"):
            found = [bag(t, slots) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"h": b.column("h"), "doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "words": pa.array([w.tobytes() for w, _ in found], pa.binary()), "sizes": pa.array([n.tobytes() for _, n in found], pa.binary())})

    bags = written(sample.where(F.col("h") < part).mapInArrow(featured, "h long, doc_id long, toxic int, words binary, sizes binary"), "bags")
    rows = [(r["h"], r["doc_id"], r["words"], r["sizes"], r["toxic"]) for r in bags.toLocalIterator()]
    rows.sort()
    model = fit([(np.frombuffer(w, np.int32), np.frombuffer(s, np.int32)) for _, _, w, s, _ in rows], [r[4] for r in rows])
    del rows
    give_back()
    return model


@functools.lru_cache(1)
def _slots() -> WordSlots:
    return WordSlots()


REMEMBERED["slots"] = [_slots.cache_clear]


def score(docs: DataFrame, model: Model, locate: bool = False) -> DataFrame:
    """Score and prediction of every row's whole text; with ``locate`` also the offending sentences (begin, text, score of at least 0.5).

    Text null or empty, or without a sentence: score 0. doc_id is carried as it is, other columns are ignored. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a number a slot: its size is fixed
    schema = "doc_id long, score double, predicted int" + (", offending array<struct<begin:int,text:string,score:double>>" if locate else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, model = _slots(), held.value
        for b in slices(batches, holds="slots"):
            scores, offending = [], []
            for text in b.column("text").fill_null("").to_pylist():
                parts = sentences(text)
                p = model.sentence_scores([s for _, s in parts], slots) if parts else np.empty(0)
                scores.append(noisy_or(p))
                if locate:
                    offending.append([{"begin": parts[i][0], "text": parts[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= 0.5)])
            out = {"doc_id": b.column("doc_id"), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}
            if locate:
                out["offending"] = pa.array(offending, pa.list_(pa.struct([("begin", pa.int32()), ("text", pa.string()), ("score", pa.float64())])))
            yield pa.record_batch(out)

    return id_and_text(docs).mapInArrow(run, schema)


def held_out(doc_id):
    """The rows that teach nothing: crc32 of the doc_id as text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with their own columns whose score is below the threshold. No shuffle; rows are judged one by one, so null and repeated doc_ids do no harm."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, model = _slots(), held.value
        for b in slices(batches, holds="slots"):
            keep = []
            for text in b.column("text").fill_null("").to_pylist():
                parts = sentences(text)
                keep.append(noisy_or(model.sentence_scores([s for _, s in parts], slots) if parts else np.empty(0)) < threshold)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
