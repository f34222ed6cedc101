"""URL rules in a sorted digest array.

The array's file holds the sorted xxhash64 keys of all rules' strings, then where each string begins, then the strings. It is
written once to the shared folder, Spark hands every executor a copy, and tasks map it into memory. A task hashes
every (domain suffix, path prefix) that could be a rule, probes all of a batch's at once by vectorised binary search, and takes
a hit only when the stored string is the same.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

MAGIC = b"TWRULES1"


def rule_file(rules: list[tuple[str, str, str]]) -> bytes:
    """The file's bytes for (verdict, host, path) rules; of equal strings one that blocks holds."""
    verdicts = {f"{host}{path}": verdict for verdict, host, path in sorted(rules)}
    lengths = {f"{host}{path}": len(path) for _, host, path in rules}
    keyed = sorted((xxhash.xxh64_intdigest(s), s) for s in verdicts)
    heap = [f"{verdicts[s][0]}{s}".encode() for _, s in keyed]
    paths = np.array(sorted(set(lengths.values())), "<i8")
    parts = [np.array([len(keyed), len(paths)], "<i8"), paths, np.array([k for k, _ in keyed], "<u8"), np.cumsum([0, *map(len, heap)], dtype="<i8")]
    return b"".join([MAGIC, *(x.tobytes() for x in parts), *heap])


class DigestArray:
    """The file, memory-mapped. find(strings) gives each one's place or -1."""

    def __init__(self, file: str):
        data = np.memmap(file, np.uint8, "r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a rule file")
        n, m = (int(x) for x in data[8:24].view("<i8"))
        at = 24 + 8 * m
        self.path_lengths = data[24:at].view("<i8").tolist()
        self.keys = data[at : at + 8 * n].view("<u8")
        self.begins = data[at + 8 * n : at + 16 * n + 8].view("<i8")
        self.heap = data[at + 16 * n + 8 :]

    def entry(self, i: int) -> tuple[str, str]:
        text = bytes(self.heap[int(self.begins[i]) : int(self.begins[i + 1])]).decode()
        return {"a": "allow", "b": "block"}[text[0]], text[1:]

    def find(self, strings: list[str]) -> np.ndarray:
        probes = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        at, out = np.searchsorted(self.keys, probes), np.full(len(strings), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probes) if len(self.keys) else np.zeros(len(strings), bool)):
            for j in range(int(at[i]), len(self.keys)):  # strings of one key lie side by side
                if self.keys[j] != probes[i]:
                    break
                if self.entry(j)[1] == strings[i]:
                    out[i] = j
                    break
        return out


@functools.lru_cache(4)
def opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty where there is no ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends, default=len(rest))]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def candidates(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Every string that a fitting rule could have, longest first."""
    if not host:
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    return sorted((s + path[:n] for s in suffixes for n in path_lengths if n <= len(path)), key=lambda x: (-len(x), x))


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", most_bytes: int = 512 << 20) -> DataFrame:
    """Verdict of every row's url (page_id, url; other columns are ignored).

    Of the rules that fit (host equal or a parent domain, path a prefix) the longest string wins. url null, empty or without ://: empty host and path,
    no rule, the default verdict. page_id is carried as it is. No shuffle. Rules of more than ``most_bytes`` raise ValueError: join them with judge_urls_by_join.
    """
    spark = pages.sparkSession
    data = rule_file(rules)
    if len(data) > most_bytes:
        raise ValueError("the rule file is over its bound; use judge_urls_by_join")
    uri = shared_dir(spark, "rules")
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)
    spark.sparkContext.addFile(uri)
    name = path.rpartition("/")[2]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = opened(name)
        for batch in batches:
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            tries = [candidates(h, p, array.path_lengths) for h, p in split]
            distinct = list({t for x in tries for t in x})
            known = {s: i for s, i in zip(distinct, array.find(distinct).tolist(), strict=True) if i >= 0}
            found = [next((array.entry(known[t]) for t in x if t in known), (default, None)) for x in tries]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array([x[k] for x in of], pa.string()) for of, k in ((split, 0), (split, 1), (found, 1), (found, 0)))], ["page_id", "host", "path", "rule", "verdict"]
            )

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).mapInArrow(judge, SCHEMA)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", path_lengths: list[int] | None = None) -> DataFrame:
    """The same verdicts for a table of rules (verdict, host, path) of any size: each place's possible rule strings meet the rules in a hash join.

    One row a row; equal places (host and path) are judged once. Of equal rule strings one that blocks holds.
    """
    lengths = path_lengths or [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # a few dozen distinct lengths

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [split_url(u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([x[k] for x in places], pa.string()) for k in (0, 1))], ["page_id", "host", "path"])

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [candidates(h, p, lengths) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("path"), pa.array(found, pa.list_(pa.string()))], ["host", "path", "tries"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).mapInArrow(split, "page_id long, host string, path string")
    strings = rules.select(F.concat("host", "path").alias("rule"), "verdict").groupBy("rule").agg(F.max("verdict").alias("rule_verdict"))
    places = rows.select("host", "path").distinct().mapInArrow(tries, "host string, path string, tries array<string>")
    hits = places.select("host", "path", F.explode("tries").alias("rule")).join(strings, "rule")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
