"""Spelling variants: words that differ by one code point, grouped below their most frequent forms.

A word is two segments, its halves. If another word differs from it by one inserted, deleted or replaced code point, one of the
segments stands unchanged at that word's begin or end, and so does a half of the other segment, one of its quarters. Each shard holds an
Aho-Corasick automaton of the segments that bring words to it. Words are scanned by the shards that may hold a segment of theirs: those of the hashes of segment and
quarter, so that even a segment that a third of all words share is dealt over many shards. Rows carry that hash: what is found is checked for its offset
and hash, then the distance is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, written

#: Letters of words.
LETTERS = "A-Za-zÀ-ÿ"
#: Words whose segments one automaton holds, about.
WORDS_PER_SHARD = 10_000


def word_counts(docs: DataFrame, least_chars: int = 7, least: int = 2, delete_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased that have ``least_chars`` code points and are found ``least`` times or more in all texts.

    ``delete_every`` plants misspellings: of a run whose h, the crc32 of ``<doc_id>:<run>``, is a multiple of it, the code point h % length is
    deleted. Null texts have no words; a null doc_id is written as nothing. Repeated rows count each time.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                found = Counter(runs.findall(text.lower().decode(errors="replace")))  # lower() of bytes: A-Z alone
                if not delete_every:
                    seen.update(found)
                    continue
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % delete_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    seen[word] += n
            yield pa.record_batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _routes(more: int) -> list[Column]:
    """Hashes of segment and quarter as a word of ``more`` more code points would have them where they stand unchanged in ``word``."""
    size, length = F.length("word"), F.length("word") + more
    left = F.floor(length / 2).cast("int")
    right = length - left
    ql, qr = F.floor(left / 2).cast("int"), F.floor(right / 2).cast("int")
    cut = lambda start, n: F.substring("word", start, n)
    one = F.lit(1)
    head, tail = cut(one, left), cut(size - right + 1, right)
    return [F.xxhash64(F.lit(0), head, cut(left + 1, qr)), F.xxhash64(F.lit(1), head, cut(size - (right - qr) + 1, right - qr)), F.xxhash64(F.lit(2), tail, cut(one, ql)), F.xxhash64(F.lit(3), tail, cut(size - right - (left - ql) + 1, left - ql))]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Halves:
    """An automaton of segments. A row (key, side, word, n) is a word by one of its segments, the left one if ``side`` is 0, and the hash of that and of a quarter."""

    def __init__(self, rows: list[tuple[int, int, str, int]]):
        self.automaton = ahocorasick.Automaton()
        held: dict[str, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for key, side, word, n in rows:
            half = len(word) // 2
            held[word[half:] if side else word[:half]][key].append((word, n))
        for segment, by_key in held.items():
            self.automaton.add_word(segment, (len(segment), by_key))
        self.automaton.make_automaton()

    def near(self, word: str, key: int) -> list[tuple[str, int]]:
        """The smaller words held under ``key`` that are one edit from ``word``, some more than once."""
        found, end = [], len(word) - 1
        for last, (size, by_key) in self.automaton.iter(word):
            if (last == size - 1 or last == end) and key in by_key:
                found += [x for x in by_key[key] if x[0] < word and one_edit(x[0], word)]
        return found


def near_pairs(words: DataFrame, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """(word, other, other_n) of all words (word, n) of 4 code points or more that are one edit apart, in both directions. Each word is a row of its own."""
    shards = max(1, 4 * words.count() // words_per_shard)
    own = F.array(*(F.struct(h.alias("key"), F.lit(side).alias("side")) for h, side in zip(_routes(0), (0, 0, 1, 1), strict=True)))
    held = words.select(F.explode(own).alias("at"), "word", "n").select("at.key", "at.side", "word", "n")
    scanned = words.select(F.explode(F.array_distinct(F.array(*_routes(-1), *_routes(0), *_routes(1)))).alias("key"), F.lit(2).alias("side"), "word", "n")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, holds, automaton = None, [], None
        for batch in batches:
            a, b, m = [], [], []
            keys = batch.column("key").to_numpy()
            columns = (keys % shards, keys, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "word", "n")))
            for now, key, side, word, n in zip(*(c.tolist() for c in columns), strict=True):
                if now != shard:
                    shard, holds, automaton = now, [], None
                if side != 2:
                    holds.append((key, side, word, n))
                    continue
                if automaton is None:
                    automaton = Halves(holds)
                for other, k in automaton.near(word, key):
                    a += (word, other)
                    b += (other, word)
                    m += (k, n)
            yield pa.record_batch({"word": pa.array(a, pa.string()), "other": pa.array(b, pa.string()), "other_n": pa.array(m, pa.int64())})

    shard = F.pmod("key", F.lit(shards))
    dealt = held.unionAll(scanned).repartition(shard).sortWithinPartitions(shard, "side")
    return dealt.mapInArrow(scan, "word string, other string, other_n long").distinct()


def variant_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n).

    n_near counts the words one edit away. form is the most frequent of them (of equal ones the smallest in code-point order) if it is found ``times`` times as often
    or more, else null, and form_n its n. root follows forms to the last, and is the word itself without one. An empty table gives no rows. Words of under 4 code points
    aren't supported, as their segments have no quarters.
    """
    words = written(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    found = written(found, "forms")
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # a form is found ``times`` times as often, so chains are short, and every round doubles what is followed
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
