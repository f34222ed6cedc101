"""run() over the small table: what joins, cutting and packing make of the documents that toxicity and quality keep, by plain loops."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P

SF = "/root/testdata/sf0.001"


def smallest_of_each_group(texts: dict) -> list:
    sets = {}
    for i, text in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [i for i in texts if find(i) == i]


def cut(texts: dict, length: int = 50) -> dict:
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = set()
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                gone.update(range(p, p + length))
        out[i] = bytes(c for p, c in enumerate(b) if p not in gone).decode("utf-8", "ignore") if gone else texts[i]
    return out


def test_run(spark):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = cp.written(cp.drop_toxic(spark, docs, SF), "clean")
    texts = {r["doc_id"]: r["text"] for r in cp.written(cp.drop_outliers(spark, clean, SF), "typical").collect()}
    kept = smallest_of_each_group(texts)
    want = cut({i: texts[i] for i in kept})
    assert len(kept) < len(texts) and any(want[i] != texts[i] for i in kept)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in want.items()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in cp.run(spark, SF).collect():
        i, begin, n = r["doc_id"], r["start"], r["length"]
        assert r["doc_tokens"] == len(ids[i]) and zlib.crc32(np.array(ids[i][begin : begin + n], "<u4").tobytes()) == r["ids_crc32"]
        pieces[i].append((begin, n))
        bins[r["sequence_id"]].append((r["offset"], n))
    assert set(pieces) == set(kept)
    for parts, whole in [*((p, len(ids[i])) for i, p in pieces.items()), *((p, None) for p in bins.values())]:
        at = 0
        for begin, n in sorted(parts):
            assert begin == at and n > 0
            at += n
        assert at == whole if whole is not None else at <= 2048


def test_stages_with_odd_rows(spark):
    """Null and repeated doc_ids, null texts, columns with names of the stages' own, empty tables: rows are judged one by one and keep all their columns."""
    import corpus_pipeline as cp

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    plain = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, spans string, row int, n_words int")
    stay = {r["doc_id"] for r in cp.drop_toxic(spark, plain, SF).collect()}
    toxic = next(d for d in docs if d[0] not in stay and labels.get(d[0], 1) == 1)
    clean = next(d for d in docs if d[0] not in labels and d[0] in stay and len(d[1] or "") > 300)  # teaches nothing
    odd = [(None, toxic[1], *toxic[2:]), (None, clean[1], *clean[2:]), (clean[0], toxic[1], *toxic[2:]), (99_999, None, None, None, None, None, None, None), (99_998, "", "en", "s", 0, "x", 1, 2)]
    frame = plain.unionAll(spark.createDataFrame(odd, plain.schema))
    kept = cp.written(cp.drop_toxic(spark, frame, SF), "t")
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == frame.columns and (None, toxic[1]) not in texts and (clean[0], toxic[1]) not in texts and {(None, clean[1]), (clean[0], clean[1]), (99_999, None)} <= set(texts)
    for _, stage in cp.STAGES[1:4]:
        after = cp.written(stage(spark, kept, SF), "t")
        assert after.columns == frame.columns and after.count() <= kept.count() and stage(spark, frame.limit(0), SF).count() == 0
        kept = after
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in cp.pack(spark, kept, SF).select("doc_id").collect()}
