"""Phrases of words that stand together, mined language by language.

Texts are cut into n-grams of 1 to ``most_words`` words, which become rows of language, phrase and count and are summed by a hash
aggregation, length by length. An n-gram is made a row only if both of its parts of n - 1 words were counted often enough,
which a bitmap of bounded size tells (with a few more let through): no other can reach the least count. Counts of first and last parts are joined,
scores are exact decimals, phrases that a phrase of one more word accounts for go by an anti-join, and a window ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import INVERSE, LEAST_BITS, MOST_BITS, mixed, powers, prefix_hashes, slices, steady, string_hashes, utf8, written

#: Bytes that end a piece, blanks between words, and A-Z as a-z.
CUTS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(CUTS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NO_LANG = "und"


def _places(starts: np.ndarray, to: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each byte of a copy where it comes from: runs of ``lengths`` bytes that begin at ``starts`` and lie at ``to``. A slice has fewer than 2**31 bytes."""
    out = np.repeat((starts - to).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Words:
    """The words of a batch of texts: a buffer with one blank after each, where they start and end there, the piece and the text of each."""

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = KIND[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([1], kind != 0)).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        lengths = ends - starts + 1
        self.ends = np.cumsum(lengths) - 1
        self.starts = self.ends + 1 - lengths
        self.data = data[_places(starts, self.starts, lengths)]
        self.data[self.ends] = 32

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, salt: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word with the salt of its text's language."""
        h = prefix_hashes(self.data)
        own = (h[self.ends] - h[self.starts]) * powers(len(self.data) + 1, INVERSE)[self.starts]
        return mixed(mixed(own ^ (self.ends - self.starts).astype(np.uint64)) ^ salt[self.text])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n-grams that begin at the given words, as strings."""
        starts, lengths = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        chars = self.data[_places(starts, offsets[:-1], lengths)]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars)])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Of each n consecutive word hashes one hash."""
    out = words[: max(0, len(words) - n + 1)]
    for i in range(1, n):
        out = mixed(out ^ (words[i : len(words) - n + 1 + i] * np.uint64(2 * i + 1)))
    return out


def salts(langs: pa.Array) -> np.ndarray:
    return string_hashes(langs) if len(langs) else np.empty(0, np.uint64)


def gram_counts(docs: DataFrame, n: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, count) of n-grams within pieces; a phrase has a row for each slice of texts that holds it. frequent: marks of the (n - 1)-grams that matter."""
    bitmap = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_BITS at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in slices(batches):
            langs = batch.column("lang")
            words = Words(utf8(batch.column("text")))
            at = np.arange(max(0, len(words) - n + 1))
            if n > 1 and len(at):
                near = words.piece[: len(at)] == words.piece[n - 1 :]
                if bitmap is not None:
                    hit = marked(bitmap.value, gram_hashes(words.hashes(salts(langs)), n - 1))
                    near &= hit[:-1] & hit[1:]
                at = at[near]
            rows = pa.table({"lang": langs.dictionary_encode().indices.take(pa.array(words.text[at])), "phrase": words.phrases(at, n)})
            rows = rows.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
            names = langs.dictionary_encode().dictionary
            yield from pa.table({"lang": names.take(rows["lang"].combine_chunks()), "phrase": rows["phrase"], "count": rows["count_all"]}).to_batches(50_000)

    return docs.mapInArrow(counted, "lang string, phrase string, count long")


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marks(grams: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of phrases (lang, phrase), of MOST_BITS at most, gathered by an aggregation that is partial in each task."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * grams.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase"):
            texts = utf8(batch.column("phrase"))
            words = Words(texts)
            h = words.hashes(salts(batch.column("lang")))
            n = np.bincount(words.text, minlength=len(texts))
            first = np.cumsum(n) - n
            out = np.empty(len(texts), np.uint64)
            for k in np.unique(n):  # phrases have few lengths
                rows = np.flatnonzero(n == k)
                out[rows] = gram_hashes(h, k)[first[rows]]
            yield pa.record_batch({"place": (out & np.uint64(bits - 1)).astype(np.int64)})

    place = F.col("place")
    rows = grams.mapInArrow(places, "place long").groupBy(F.floor(place / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for k, part in zip(rows["k"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[4096 * k : 4096 * k + len(part)] = np.frombuffer(part, np.uint8)
    return out


def phrase_counts(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, words, f) of all n-grams found ``least`` times or more. docs: lang, text."""
    totals, levels, frequent = None, [], None
    for n in range(1, most_words + 1):
        counts = gram_counts(docs, n, frequent).groupBy("lang", "phrase").agg(F.sum("count").alias("f"))
        if n == 1:
            counts = written(counts, "words")
            totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        levels.append(written(counts.where(F.col("f") >= least).withColumn("words", F.lit(n)), f"phrases-{n}"))
        if n < most_words:
            frequent = marks(levels[-1])
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return totals, out


def mine_phrases(docs: DataFrame, most_words: int = 4, least: int = 30, accounted: int = 80, best: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score (all numbers long).

    Words are A-Z lower-cased and within pieces of a text. A phrase of 2 to ``most_words`` words found a times (``least`` or more) has for each cut
    into two parts, found l and r times, the score floor(scale * a / (l + r)); its lowest one counts, of equal ones that with the shortest first part.
    Phrases that lie within one of more words found at least ``accounted`` percent as often go. Ranks are by score and a, both
    falling, then by the phrase's UTF-8 bytes.

    Null texts have no words, a null lang counts as ``und``; doc_id isn't used, so repeated rows count each time. A language without candidates, or
    an empty table, gives no rows. Other columns are left out.
    """
    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(NO_LANG)).alias("lang"), docs["text"].cast("string").alias("text"))
    totals, counted = phrase_counts(own, most_words, least)
    candidates = counted.where("words > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(split, start, n), " ")
    longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))).alias("phrase"))
    # what lies in a phrase of several more words lies in one of one more word, found at least as often
    gone = candidates.join(longer.groupBy("lang", "phrase").agg(F.max("a").alias("most")), ["lang", "phrase"]).where(F.col("most") * F.lit(100).cast("decimal(20,0)") >= F.col("a") * F.lit(accounted).cast("decimal(20,0)"))
    kept = candidates.join(gone.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    found = counted.select("lang", "phrase", "f")
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = F.expr(f"CAST(a AS DECIMAL(28,0)) * CAST({scale} AS DECIMAL(10,0)) DIV (CAST(l AS DECIMAL(28,0)) + CAST(r AS DECIMAL(28,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
