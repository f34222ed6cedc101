"""Windows of documents go by digests, and digests stand for texts."""

from treewarden.operators.analyzers import clusters, collapse
from treewarden.queries.source import BY_DIGEST, _document_windows

SF = "/root/testdata/sf0.001"


def test_no_text_is_shuffled(spark):
    assert _document_windows(spark, SF).columns == ["repo", "path", "start_line", *BY_DIGEST]


def test_one_digest_alone_makes_no_cluster(spark):
    """Two texts with one first digest, each in two places; as one cluster there would be four."""
    rows = [("r", p, n, b"x" * 16, other) for p, n, other in [("a", 1, 1), ("a", 9, 2), ("b", 1, 2), ("b", 3, 1), ("c", 1, 3)]]
    found = spark.createDataFrame(rows, "repo string, path string, start_line int, win binary, other long")
    got = clusters(found, BY_DIGEST)
    assert sorted((r["path"], r["start_line"], r["n"], r["rank"], [tuple(p) for p in r["places"]]) for r in got.collect()) == [
        ("a", 1, 2, 1, [("a", 1), ("b", 3)]), ("a", 9, 2, 1, [("a", 9), ("b", 1)]), ("b", 1, 2, 2, [("a", 9), ("b", 1)]), ("b", 3, 2, 2, [("a", 1), ("b", 3)]),
    ]
    assert "places" not in clusters(found, BY_DIGEST, places=False).columns
    assert sorted((r["path"], r["start_line"]) for r in collapse(got, BY_DIGEST).collect()) == [("a", 1), ("a", 9), ("b", 1)]
