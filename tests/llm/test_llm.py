"""Each numbered operator against a brute-force version, and the edge cases its docstring defines."""

import hashlib
import io
import random
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from treewarden.llm import ann, byte_bpe, common, encoding, ngram_join, packing, quality, suffix_dedup, token_store, toxicity, url_filter, warc

WORDS = [f"w{i}" for i in range(40)]
DOCS = "doc_id long, text string, lang string, source string, spans string, _place0 int"


def texts(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with copies, near copies, a shared passage, and the odd ones: null, empty, very long, no id, repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=40))
    out = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 120)))
        if i % 5 == 1:
            text = out[rng.randrange(len(out))][1] or "x"
        elif i % 5 == 2:
            words = (out[rng.randrange(len(out))][1] or "x").split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 5 == 3:
            text = f"{text} {passage} é\n{text[:30]}"
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "ab " * 20_000), (None, out[0][1]), (0, out[0][1]), (n + 4, "日本語 text"), (n + 5, "a<|endoftext|>b <|endoftext|> c")]
    return [(i, t, ("en", None)[(i or 0) % 2], "s", "clash", 1) for i, t in out]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts(docs, none, rows):
    got = quality.judge_quality(docs).collect()
    assert len(got) == len(rows) and quality.judge_quality(none).count() == 0
    for r in got:
        assert not (r["base_failed"] and r["kept"])
    assert quality.text_counts(b"a b c d e x a b c d e\n\na\na\n#", 28)[:4] == (14, 14, 1, 1)
    words = random.Random(3).choices("abc", k=200)
    windows = defaultdict(list)
    for i in range(196):
        windows[tuple(words[i : i + 5])].append(i)
    brute = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    assert quality.repeated_words(words) == len(brute)


def test_quality_rejects_outliers(spark):
    rng = random.Random(5)
    clean = [(i, " ".join("x" * rng.randint(2, 8) for _ in range(rng.randint(20, 300))), "en", "s", "", 1) for i in range(300)]
    junk = [(1000 + i, " ".join("x" * rng.randint(2, 8) + "###$" for _ in range(100)), "en", "s", "", 1) for i in range(20)]
    got = by_id(quality.judge_quality(spark.createDataFrame(clean + junk, DOCS)))
    assert not any(got[r[0]]["kept"] for r in junk) and sum(got[r[0]]["kept"] or got[r[0]]["base_failed"] for r in clean) == len(clean)


def plain_mcd(rows, least_rows=60):
    """Verdicts of (lang, source, counts) rows by plain loops: concentration steps on arrays of one group after the other."""
    q = quality
    failed = [n[0] < 10 or 100 * n[4] > 20 * n[0] for _, _, n in rows]
    x = []
    for _, _, (words, chars, symbols, dup, repeated, lines) in rows:
        n = words + 30
        v = (np.log1p(words), np.log((chars + 150) / n), np.log1p(4 * symbols / n), np.sqrt(dup / max(lines, 1)) * lines / (lines + 5), np.sqrt(repeated / n))
        x.append([float(np.floor(abs(c * q.SCALE) + 0.5)) * (1 if c >= 0 else -1) for c in v])
    x, floors = np.array(x), np.array(q.FLOORS) * q.SCALE
    groups = defaultdict(list)
    for i, (lang, source, _) in enumerate(rows):
        if not failed[i]:
            groups[(lang or "", source or "")].append(i)
    pooled = defaultdict(list)
    for (lang, source), at in groups.items():
        pooled[(lang, source if len(at) >= least_rows else None)] += at
    kept = [False] * len(rows)
    rounded = lambda d: np.floor(np.log(d + 1e-6) * 64 + 0.5)
    for at in pooled.values():
        y = x[at]
        far = lambda m, p: ((y - m) @ p * (y - m)).sum(1)  # noqa: E731, B023
        centre = np.median(y, 0)
        mad = np.maximum(1.4826 * np.median(np.abs(np.trunc(y - centre + 0.5 * np.sign(y - centre))), 0), floors / 4)
        squash = np.round(q.SCALE * np.tanh((y - centre) / mad))
        c = np.cov(squash.T, bias=True).reshape(5, 5)
        sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
        corr = 0.9 * c / np.outer(sd, sd)
        np.fill_diagonal(corr, 1)

        def step(m, p, floor, grown=False):
            d = rounded(far(m, p))
            most = np.sort(d)[(len(y) + 5) // 2 if len(y) > 5 else len(y) - 1]
            near = y[d <= most]
            cov = near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0))
            cov = cov * (np.exp(most / 64) / q.CHI_MEDIAN if grown else 1) + np.diag(floor**2)
            return near.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

        ends = []
        for scatter in (np.diag(mad**2), corr * np.outer(mad, mad)):
            now = step(centre, np.linalg.inv(scatter), floors / 4)
            while (after := step(*now[:2], floors / 4))[2] < now[2] - 1e-9:
                now = after
            ends.append(now)
        m, p, _ = step(*min(ends, key=lambda e: e[2])[:2], floors, grown=True)
        for i, d in zip(at, far(m, p), strict=True):
            kept[i] = d <= q.CHI_CUTOFF
    return failed, kept


def test_quality_against_plain_mcd(spark):
    """Every row's verdict and distance side: groups of many rows, of a few that share an estimate, of one row, without variance, with null names, odd texts."""
    rng = random.Random(11)
    data = []
    for i in range(700):
        lang, source = ("en", None)[i % 2], ("a", "b", None, f"rare{i % 40}")[rng.randrange(4)]
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(1, 400))]
        if i % 9 == 0:
            words += ["#$%"] * rng.randint(1, 60)
        if i % 11 == 0:
            words += ["same", "line", "of", "words", "here", "\n"] * rng.randint(2, 30)
        data.append((i if i % 50 else None, " ".join(words), lang, source, "clash", 1))
    data += [(1000 + i, "one two three four five six seven eight nine ten eleven", "flat", "s", "", 1) for i in range(70)] + [(2000, "word " * 11, "lone", "s", "", 1), (2001, "a b c d e f g h i j k l", "lone", "s", "", 1), (2002, None, "en", "a", "", 1), (2003, "", "en", "a", "", 1), (2004, "long " + " ".join(str(j) for j in range(30_000)), "en", "a", "", 1)]
    failed, kept = plain_mcd([(lang, source, quality.text_counts((t or "").encode(), len(t or ""))) for _, t, lang, source, *_ in data])
    frame = spark.createDataFrame(data, DOCS)
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["base_failed"], r["kept"]) for r in quality.judge_quality(frame).collect())
    counts = [quality.text_counts((t or "").encode(), len(t or "")) for _, t, *_ in data]
    assert got == sorted((str(i), *n[:3], f, k) for (i, *_), n, f, k in zip(data, counts, failed, kept, strict=True))
    assert 20 < sum(kept) < len(kept) - sum(failed)
    typical = quality.keep_typical(frame)
    assert typical.columns == frame.columns and sorted(map(str, map(tuple, typical.collect()))) == sorted(str(d) for d, k in zip(data, kept, strict=True) if k)


def test_stages_take_any_column_name(spark, rows):
    """Names that no DDL string could hold."""
    odd = spark.createDataFrame([(i, t, g, s, "x", 1) for i, t, g, s, *_ in rows], DOCS).withColumnsRenamed({"spans": "my col", "_place0": "a:b, c` d"})
    kept = quality.keep_typical(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < len(rows)
    assert suffix_dedup.without_repeats(odd, length=50).columns == odd.columns


def test_url_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = ["http://a.net/x", "http://a.net", "http://www.EXAMPLE.net/en/1?q", "http://badexample.com/de/x", "https://x.example.com/de/", "http://a.org/fr/#t", "nothing", "", None, "http://q?://net/", "://net/", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(url):
        host, path = url_filter.split_url(url)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    pages, want = pages.unionAll(pages.where("page_id < 3")), sorted(map(str, [(i, *brute(u)) for i, u in enumerate(urls)] + [(i, *brute(u)) for i, u in enumerate(urls[:3])]))
    assert sorted(str(tuple(r)) for r in url_filter.judge_urls(pages, rules).collect()) == want
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(str(tuple(r)) for r in url_filter.judge_urls_by_join(pages, table).collect()) == want
    both = [("block", "a.net", "/"), ("allow", "a.net", "/")]
    for one in (both, both[::-1]):
        got = {r["page_id"]: r["verdict"] for judge in (url_filter.judge_urls(pages, one), url_filter.judge_urls_by_join(pages, spark.createDataFrame(one, table.schema))) for r in judge.where("page_id = 0").collect()}
        assert got == {0: "block"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in (np.sort(rng.integers(0, 10**9, 2000)), np.zeros(5, int), np.arange(700), np.array([7]), np.array([], int)):
        ef = token_store.EliasFano.of(values)
        assert [x for b in ef.blocks() for x in b.tolist()] == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_token_store(docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(token_store.read_store(token_store.write_store(docs, P.path("byte_bpe_50k.json"), ids_per_shard=5000)).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows) and [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in got) or got[0]["doc_id"] is None
    at = 0
    want = defaultdict(set)
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[i].add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    assert token_store.read_store(token_store.write_store(none, P.path("byte_bpe_50k.json"))).count() == 0


def test_byte_bpe(docs, none, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoding.read_ranks(path), special_tokens={})
    want = {i: own.encode_ordinary(t or "") for i, t, *_ in rows}
    for r in byte_bpe.digests(docs, path, P.PATTERN).collect():
        ids = want[r["doc_id"]]
        begins = np.cumsum([0, *(len(own.decode_single_token_bytes(i)) for i in ids)])[:-1] if ids else []
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest(), hashlib.sha256(np.array(begins, "<u4").tobytes()).hexdigest())
    assert byte_bpe.digests(none, path, P.PATTERN).count() == 0
    rng, decoder = random.Random(7), byte_bpe.byte_table(path)
    for _ in range(400):
        s = "".join(rng.choice("ab  \n\n\t éßñ中😀.,'s12\x85\x00") for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(encoding.ranks_encoder(path, P.PATTERN).encode([s])[0], "<u4").tolist()
        assert ids == own.encode_ordinary(s)
        stream = byte_bpe.Decoder(decoder)
        assert "".join([stream.feed([i]) for i in ids] + [stream.feed([], True)]) == s
        assert [e - b for _, b, e in byte_bpe.offsets(s, path, P.PATTERN)] == [len(own.decode_single_token_bytes(i)) for i in ids]


def test_encoder_cuts_only_what_it_may():
    from tokenizers import Tokenizer

    texts = ["one two\n three  four", "a<|endoftext|>b", "", "x 1234567 <|endoftext|>", "It's a <|startoftext|> TEST"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(P.path(name))
        for as_text in (False, True):
            t.encode_special_tokens = as_text
            assert [np.frombuffer(x, "<u4").tolist() for x in encoding.json_encoder(P.path(name), as_text).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    import tiktoken

    path, digits = P.path("byte_bpe_multi_50k.tiktoken"), r"\p{N}{1,3}|[^\p{N}]+"
    own = tiktoken.Encoding("own", pat_str=digits, mergeable_ranks=encoding.read_ranks(path), special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in encoding.ranks_encoder(path, digits).encode(texts)] == [own.encode_ordinary(x) for x in texts]


def test_toxicity(spark, docs, none):
    rng = random.Random(9)
    sample = []
    for i in range(400):
        parts = [" ".join(rng.choices(WORDS, k=8)) for _ in range(5)]
        if bad := i % 4 == 0:
            parts[rng.randrange(5)] += " " + rng.choice(["nasty", "awful"])
        sample.append((". ".join(parts), int(bad)))
    model = toxicity.fit([toxicity.bag(t, toxicity.WordSlots()) for t, _ in sample[:300]], [y for _, y in sample[:300]])
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(sample)], "doc_id long, text string")
    got = by_id(toxicity.score(frame, model, locate=True))
    assert all(got[i]["predicted"] == sample[i][1] for i in range(300, 400))
    assert all(("nasty" in o["text"] or "awful" in o["text"]) for r in got.values() for o in r["offending"])
    assert by_id(toxicity.score(docs, model))[60]["score"] == 0 and toxicity.score(none, model).count() == 0
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights.sum() == 0


def test_toxicity_of_held_out_rows(spark):
    """On the given tables: what is learned holds for labelled rows that taught nothing, and toxic rows have sentences that are located."""
    from treewarden.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.01"
    rows = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    assert not any(r["predicted"] for r in rows if not r["toxic"])
    located = [r for r in rows if r["offending"]]
    assert located and all(r["predicted"] for r in located) and all(0.5 <= s["score"] <= r["score"] + 1e-9 for r in located for s in r["offending"])


def test_toxicity_scores_by_hand(spark, docs, rows):
    """Every score and offending sentence by plain loops from the weights; the split by crc32; what teaches and what doesn't."""
    import re

    import xxhash

    weights = np.random.default_rng(3).normal(0, 0.4, toxicity.SLOTS).astype(np.float32)
    model = toxicity.Model(-3.0, weights)

    def plain(text):
        out = []
        for part in re.split(r"[.!?\n]+", text or ""):
            slots = set()
            for w in part.split():
                w = w.lower().strip(toxicity._EDGES)
                slots |= {xxhash.xxh64_intdigest(x) % toxicity.SLOTS for x in ([w] if w else []) + [f"{w[:n]}-" for n in (4, 5) if len(w) >= n]}
            if part.strip():
                out.append(1 / (1 + np.exp(-np.clip(-3.0 + sum(float(weights[i]) for i in slots), -30, 30))))
        return 1 - np.prod([1 - p for p in out]) if out else 0.0, sum(p >= 0.5 for p in out)

    want = sorted((str(i), round(plain(t)[0], 6), int(plain(t)[0] >= 0.5), int(plain(t)[1])) for i, t, *_ in rows)
    got = sorted((str(r["doc_id"]), round(r["score"], 6), r["predicted"], len(r["offending"])) for r in toxicity.score(docs, model, locate=True).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] == pytest.approx(w[1], abs=2e-6) and g[2:] == w[2:] for g, w in zip(got, want, strict=True))
    ids = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "doc_id long")
    assert {r["doc_id"]: r["h"] for r in ids.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect() if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}
    sample = spark.createDataFrame([(i, ("nasty " if i % 2 else "fine ") + "words here") for i in range(60)] + [(None, "nasty"), (5, None)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    clean = toxicity.train(sample, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = toxicity.train(sample, spark.createDataFrame(labels + [(None, 0), (3, None), (3, 0), (777, 1)], "doc_id long, toxic int"))
    assert (clean.weights == odd.weights).all() and clean.bias == odd.bias and by_id(toxicity.score(sample, clean))[1]["predicted"] == 1


def test_jaccard_components(docs, none, rows):
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        sets = {}
        for i, text, *_ in rows:
            w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
            sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
        ids = [i for i in sets if i is not None]
        root = {i: i for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = ngram_join.jaccard_components(docs, n, percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == (None if r["doc_id"] is None else find(r["doc_id"]))
    assert ngram_join.jaccard_components(none).count() == 0


def brute_nearest(data, is_query, k):
    """By (id, vector) of the queries: [(id, score)], ties to smaller ids; a query's own id never."""
    rows = [(i, np.array(v, float)) for i, v, *_ in data if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in rows:
        if is_query(i):
            scored = sorted(((-float((x * q).sum()), j) for j, x in rows if j != i))[:k]
            out[(i, tuple(q))] = [(j, -s) for s, j in scored]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).round(3)
    x[100:160] = x[5]
    odd = [(900, None, "c"), (901, [0.0] * 8, "c"), (902, [float("nan")] * 8, "c"), (903, [None] * 8, "c"), (904, [1.0] * 3, "c")]
    frame = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>, leaf string")
    want = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], lambda i: i % 20 == 0, 10)
    got = defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, k=10, sample=300, rows_per_leaf=10, block=90, at_once=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for (q, v), answers in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 11)) and got[q] == sorted(got[q], key=lambda a: (-a[2], a[1]))
        assert all(s == pytest.approx(float((x[i] * v).sum()), abs=1e-12) for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & {i for i, _ in answers})
    assert hits >= 0.9 * 10 * len(want) and set(got) == {q for q, _ in want}
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_repeated_ids_and_ties(spark):
    """All leaves visited: exactly the brute-force answers, ties at the last rank and rows that repeat an id included."""
    data = [(7, [100.0, 100.0]), (7, [90.0, 90.0]), (7, [90.0, 90.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [2.0, 0.0]), (40, [0.0, 2.0]), (60, [1.0, 1.0]), (9, [-1.0, 0.5])]
    for k in (2, 3, 5, 30):
        want = brute_nearest(data, lambda i: i % 20 == 0, k)
        got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=k, recall=1.0).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((i, n, j, s) for (i, _), answers in want.items() for n, (j, s) in enumerate(answers, 1))


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.harmonic_pack(docs.dropDuplicates(["doc_id"]), P.path("byte_bpe_50k.json"), group=2).collect()
    ids = {i: [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text, *_ in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for name, parts, whole in [*((i, sorted(p), len(ids[i])) for i, p in pieces.items()), *((i, sorted(p), None) for i, p in bins.items())]:
        at = 0
        for begin, length in parts:
            assert begin == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 2048, name
    assert set(pieces) == set(ids) and packing.harmonic_pack(none, P.path("byte_bpe_50k.json")).count() == 0
    # repeated rows, each packed by itself, and little padding
    every = packing.harmonic_pack(docs.unionAll(docs), P.path("byte_bpe_50k.json")).collect()
    whole = 2 * sum(len(t.encode(text or "", add_special_tokens=False).ids) + 1 for _, text, *_ in rows)
    bins = {r["sequence_id"] for r in every}
    assert sum(r["length"] for r in every) == whole and sum(r["doc_tokens"] for r in every if r["start"] == 0) == whole and len(bins) * 2048 <= 1.1 * whole + 3 * 2048


def brute_removed(rows, length):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1) if i is not None else ():
            first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = {}
    for i, text, *_ in rows:
        b, gone = (text or "").encode(), set()
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p : p + length]] < i:
                gone.update(range(p, p + length))
        out[i] = (len(b), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in gone)).hexdigest())
    return out


def test_suffix_dedup(spark, docs, none, rows):
    want = brute_removed(rows, 50)
    assert sum(w[1] > 0 for w in want.values()) > 10
    for r in suffix_dedup.digests(docs, 50).collect():
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    src = spark.createDataFrame(rows, DOCS)
    assert {(r["doc_id"], b, e) for r in suffix_dedup.repeated_spans(src, 50, hot=3).collect() for b, e in [(s["begin"], s["end"]) for s in r["spans"]]} != set()
    assert suffix_dedup.digests(none).count() == 0
    kept = suffix_dedup.without_repeats(docs, 50)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_suffix_dedup_hot_anchors(docs, rows):
    spans = defaultdict(list)
    for r in suffix_dedup.repeated_spans(docs, 50, hot=2, slices_at_once=100).collect():  # two rounds
        spans[r["doc_id"]] = [(s["begin"], s["end"]) for s in r["spans"]]
    want = brute_removed(rows, 50)
    for i, text, *_ in rows:
        if i is not None:
            assert suffix_dedup.removed((text or "").encode(), spans[i])[1] == want[i][1]


def test_suffix_order():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    starts, keys = np.arange(480), rng.integers(0, 4, 480)
    order, same = suffix_dedup.sort_suffixes(data, starts, keys, 20)
    text = [(keys[i], data[i : i + 20].tobytes()) for i in range(480)]
    assert [text[i] for i in order] == sorted(text) and same.tolist() == [False] + [a == b for a, b in zip(sorted(text), sorted(text)[1:], strict=False)]


def test_suffix_memory():
    """Many equal suffixes, as around a common passage, take a few numbers each."""
    rows = np.tile(np.frombuffer(b"one passage that stands in very many documents, word by word, again and again", np.uint8)[:76], (40_000, 1))
    tracemalloc.start()
    order, same = suffix_dedup.sort_suffixes(rows.ravel(), np.arange(40_000) * 76, np.zeros(40_000, np.uint64), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order.tolist()) == list(range(40_000)) and same.sum() == 39_999 and peak < 100 * 40_000


def test_suffix_dedup_common_passage(spark):
    """One passage in other surroundings of each document: of a slice, only the smallest document's strings go on; results are those of brute force, repeated ends and zero bytes included."""
    rng = random.Random(3)
    passage = "a passage of some sixty bytes which every document repeats once."
    rows = [(i, "".join(rng.choices("abcdefgh \0", k=90)) + passage + "".join(rng.choices("abcdefgh \0", k=90 * (i % 3 > 0))), "en", "s", "x", 1) for i in range(80)]
    data = np.frombuffer("".join(text for _, text, *_ in rows).encode(), np.uint8)
    lengths = np.array([len(text) for _, text, *_ in rows])
    at, _ = suffix_dedup.anchors(np.frombuffer(passage.encode(), np.uint8), np.array([len(passage)]), 50)
    begin = np.cumsum(lengths) - lengths + 90 + at[0]
    doc, around = np.arange(80)[::-1], np.lib.stride_tricks.sliding_window_view(np.pad(data, 26), 76)[begin]
    row, a, strings, again = suffix_dedup.strings_around(doc, np.full(80, 26), np.full(80, 26), around, 50)
    first = defaultdict(lambda: 80)
    for r, x in zip(row, strings, strict=True):
        first[x.tobytes()] = min(first[x.tobytes()], doc[r])
    assert again.sum() > 79 and again.tolist() == [doc[r] > first[x.tobytes()] for r, x in zip(row, strings, strict=True)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_removed(rows, 50)
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in suffix_dedup.digests(docs, 50).collect())
    for hot in (2, 40):
        spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in suffix_dedup.repeated_spans(docs, 50, hot=hot).collect()}
        assert all(suffix_dedup.removed(text.encode(), spans.get(i, []))[1] == want[i][1] for i, text, *_ in rows)


def test_written_drops_its_shuffles(spark):
    left = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, kept = left(), spark.conf.get(common.CLEANUP)
    rows = common.written(spark.range(1000).repartition(3, "id"), "rows", drop_shuffles=True)
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.2)
    assert left() <= before and rows.count() == 1000 and spark.conf.get(common.CLEANUP) == kept


def test_warc(spark, tmp_path):
    html = ["x" * 100, "x" * 100, "x" * 99, "x" * 99, None, "", "é" * 60, "a" * 3_000_000, "x" * 100, "x" * 100]
    ids = [5, 3, 1, 2, 7, 8, 9, 10, 3, None]
    pages = spark.createDataFrame([(i, f"http://a/\n{i}", h, "c") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, first string")
    got = warc.read_archives(warc.write_archives(pages, bytes_per_file=300)).collect()
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == "x" * 100 and i != 3 else "response", 3 if h == "x" * 100 and i != 3 else None) for i, h in zip(ids, html, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    data = warc.page_record(1, None, b"payload", "response", None)
    assert next(warc.read_records(io.BytesIO(data)))[1] == 7
    folder = tmp_path / "w"
    lying = warc.page_record(1, None, b"a" * 200, "response", None) + warc.page_record(2, None, b"b" * 200, "revisit", 1)
    folder.mkdir()
    (folder / "x.warc.gz").write_bytes(lying)
    with pytest.raises(ValueError, match="page 1"):
        warc.read_archives(spark.createDataFrame([(str(folder / "x.warc.gz"), "file:///", 2)], warc.MANIFEST))
    for bad in (data[:-9], warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha256:00")], b"x")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES:
        columns, before, docs = docs.columns, docs, corpus_pipeline.written(stage(spark, docs, sf), "t")
        if stage is not corpus_pipeline.pack:
            assert docs.columns == columns and docs.count() <= before.count()
    assert set(docs.columns) >= {"doc_id", "sequence_id", "offset"}
    assert corpus_pipeline.drop_toxic(spark, before.limit(0), sf).count() == 0


def test_shuffles_of_the_join_go_with_each_table(spark, monkeypatch):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = []

    def there():
        files = manager.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    def checked(df, name, *a, f=common.written, **b):
        before = there()
        out = f(df, name, *a, **b)
        until = time.time() + 10
        while left := there() - before:
            assert time.time() < until, (name, left)
            time.sleep(0.1)
        names.append(name)
        return out

    for module in (common, ngram_join):
        monkeypatch.setattr(module, "written", checked)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, f"{text} end"), (4, "another text of its own")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {"shared", "several", "edges", "tokens"} <= set(names)
