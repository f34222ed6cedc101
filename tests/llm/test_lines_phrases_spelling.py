"""op11, op12 and op13 against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from treewarden.llm import collocations, line_dedup, spelling

DOCS = "doc_id long, text string, lang string, row string, bitmap string, count int, word string, its long"
BLANKS = "\t\n\x0b\x0c\r "


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Texts of a few common and many own lines; then null, empty, blank and very long ones, no id, repeated rows and ids, other letters."""
    rng = random.Random(seed)
    common = [" Read More\t", "read more", "All rights reserved.", "Ünder Ärzte", "x", "\xa0"]
    out = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.4 else " ".join(rng.choices([f"word{k}" for k in range(30)], k=rng.randint(0, 6))) for _ in range(rng.randint(1, 12))]
        out.append((i, "\n".join(lines)))
    out += [(n, None), (n + 1, ""), (n + 2, "\n\n \n"), (n + 3, "read more\n" * 3000 + "end"), (None, "read more\nown"), (None, None), (0, out[0][1]), (1, "read more\nanother text of a known id\n"), (n + 4, "\x0b read more \r\nÀÉ\nàé")]
    return [(i, t, ("en", "de", None)[(i or 0) % 3], "r", "b", 1, "w", 7) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_lines(table, least_docs, keep_first=False):
    found = defaultdict(set)
    for doc_id, text, *_ in table:
        for line in (text or "").split("\n"):
            found[key(line)].add(doc_id)
    shared = {k for k, ids in found.items() if k and len(ids) >= least_docs}
    first = {}
    if keep_first:  # rows without an id come first
        for doc_id in sorted({r[0] for r in table}, key=lambda i: (i is not None, i)):
            for at, line in enumerate((next(r[1] for r in table if r[0] == doc_id) or "").split("\n")):
                first.setdefault(key(line), (doc_id, at))
    out = []
    for doc_id, text, *_ in table:
        lines = (text or "").split("\n")
        kept = [x for at, x in enumerate(lines) if key(x) not in shared or keep_first and first[key(x)] == (doc_id, at)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_docs", [2, 10, 1000])
def test_shared_lines(docs, none, least_docs):
    got = line_dedup.drop_shared_lines(docs, least_docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(rows(), least_docs)
    assert line_dedup.drop_shared_lines(none).count() == 0


def test_shared_lines_keep_the_first(spark):
    table = [r for r in rows() if r[0] is not None and r[0] > 1]
    got = line_dedup.drop_shared_lines(spark.createDataFrame(table, DOCS), 2, keep_first=True).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(table, 2, True)


def test_line_bitmaps_and_digests(spark, docs):
    d = spark.createDataFrame([(i, "a\nb\nb\nc%d\na" % i) for i in range(3)], "doc_id long, text string").withColumn("row", F.xxhash64("text"))
    assert {tuple(map(tuple, r["bitmap"])) for r in line_dedup.keep_bitmaps(d, 3).collect()} == {((0, 3), (4, 1))}
    assert {r["kept_sha256"] for r in line_dedup.digests(d, 3).collect()} == {hashlib.sha256(b"c%d" % i).hexdigest() for i in range(3)}
    plan = line_dedup.digests(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_phrases(table, most_words, least, accounted, best, scale):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in table:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(100 * b >= accounted * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:best])]
    return sorted(out)


def test_phrases(spark, none):
    rng = random.Random(5)
    table = [(i, "".join(rng.choice(["New York", "new  york city", "the\tbig apple", "é a", "Of the", "a a a", "x"]) + rng.choice([" ", " ", ", ", "\n", "! "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None, "und"])) for i in range(80)]
    table += [(None, None, None), (3, "", "en"), (3, "new york " * 5000, "xx"), (4, "b. c", "yy"), (5, "big" * 9000, "en"), (5, "big" * 9000, "en")]
    table = [(*r, "r", "b", 1, "w", 7) for r in table]
    df = spark.createDataFrame([(i, t, g, *x) for i, t, g, *x in table], DOCS).repartition(4)
    for args in ((4, 5, 80, 2000, 2_000_000), (4, 30, 50, 7, 2_000_000), (2, 3, 80, 2000, 10**9), (5, 2, 100, 40, 1)):
        assert sorted(map(tuple, collocations.mine_phrases(df, *args).collect())) == plain_phrases(table, *args)
    assert collocations.mine_phrases(none).count() == 0


def test_phrase_scores_past_64_bits(spark):
    """2000000 * a passes 64 bits: counts as a very large corpus has them."""
    df = spark.createDataFrame([(10**13, 2 * 10**13 + 1, 3)], "a long, l long, r long")
    assert df.select(F.expr("CAST(a AS DECIMAL(28,0)) * CAST(2000000 AS DECIMAL(10,0)) DIV (CAST(l AS DECIMAL(28,0)) + CAST(r AS DECIMAL(28,0)))")).first()[0] == 2000000 * 10**13 // (2 * 10**13 + 4)


def plain_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, times):
    form = {}
    out = []
    near = {w: [v for v in n if plain_edit(w, v)] for w in n}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variants(seed=9, letters="abé", size=250):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(7, 11))) for _ in range(40)]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 30, 400, 5000, 60000])
        for _ in range(8):
            at, c = rng.randrange(len(w) + 1), rng.choice([*letters, "z"])
            v = rng.choice([w[:at] + c + w[at:], w[: at - 1] + c + w[at:] if at else w, w[:at] + w[at + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 3, 30, 500]))
    return words


@pytest.mark.parametrize("letters", ["abé", "a", "abcdefghij"])
@pytest.mark.parametrize("shard", [10, 10_000])
def test_variant_groups(spark, letters, shard, monkeypatch):
    words = variants(letters=letters)
    monkeypatch.setattr(spelling, "near_pairs", lambda w, f=spelling.near_pairs: f(w, shard))
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"), 10).collect()
    assert sorted(map(tuple, got)) == plain_groups(words, 10)


def test_forms_in_chains(spark):
    words = {"aaaaaaaa": 10**6, "aaaaaaab": 10**5, "aaaaaabb": 10**4, "aaaaabbb": 10**3, "aaaabbbb": 100, "aaabbbbb": 10, "zzzzzzzz": 2}
    got = {r["word"]: (r["root"], r["form_n"]) for r in spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaabbbbb"] == ("aaaaaaaa", 100) and got["zzzzzzzz"] == ("zzzzzzzz", None)


def test_words_and_planted_misspellings(spark, none):
    rng = random.Random(2)
    table = [(i, " ".join(rng.choices(["Übergrößen", "ÜBERGRÖßEN", "naïveté", "letters9letters", "short", "twelve-letters", "STRASSENBAHN", "strassenbahn", "日本語 wörtlich÷teilt"], k=30))) for i in range(40)]
    table += [(None, None), (None, "strassenbahn"), (7, ""), (7, "strassenbahn strassenbahn"), (8, "long" * 9000)]
    want = Counter()
    for doc_id, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 5 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                want[w] += 1
    df = spark.createDataFrame([(*r, "en", "r", "b", 1, "w", 7) for r in table], DOCS).repartition(3)
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, 7, 2, 5).collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.variant_groups(spelling.word_counts(none)).count() == 0


def test_an_automaton_holds_the_segments_that_bring_words():
    held = spelling.Halves([(5, 0, "abcdefgh", 9), (6, 1, "abcdxfgh", 4)])
    assert sorted(held.automaton.keys()) == ["abcd", "xfgh"]  # not the halves by which other shards hold the words
    assert held.near("abcdefghi", 5) == [("abcdefgh", 9)] and held.near("abcdyxfgh", 6) == [("abcdxfgh", 4)]
    assert held.near("abcdefghi", 6) == [] == held.near("yabcdefgh", 5)
