"""Queries of the analyzers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import is_named_test, is_non_source, is_test
from ..functions.text import line_count, normalized
from ..operators import findings as fnd
from ..functions.identity import finding_payloads as finding_payloads_of
from ..operators.analyzers import REGISTRY, clusters, collapse, file_index, symbols
from ..operators.nodes import node_table, parse_errors
from ..functions.scratch import merging, shared_folder
from ..streaming.state import Incremental
from .corpus import CORPUS, files, paired, paired_files, parsed

PLAIN = ["analyzer_id", "severity", "file", "start_line", "end_line", "symbol", "message"]


def _plain(name: str, corpus=parsed):
    return lambda spark, sf_dir: REGISTRY[name].run(*corpus(spark, sf_dir)).select(*PLAIN)


def _sql(analyzer: str, rows: str, severity: str = "'info'") -> str:
    """rows: (t, start, end, symbol, message) with k in scope."""
    return f"SELECT '{analyzer}' AS analyzer_id, {severity} AS severity, path AS file, v.s AS start_line, v.e AS end_line, v.symbol, v.message FROM c, LATERAL ({rows}) v"


_MASK = _sql("risk.error-masking", "SELECT 4 AS s, 5 AS e, CAST(NULL AS VARCHAR) AS symbol, 'except clause swallows errors (' || CASE t WHEN 0 THEN 'bare' WHEN 1 THEN 'broad' ELSE 'specific' END || '-except)' AS message WHERE t IN (0, 1, 2)", "CASE WHEN t = 2 OR aside THEN 'info' ELSE 'warn' END")
_MUTABLE = _sql("arg.mutable-default", "SELECT 1 AS s, 1 AS e, 'b' AS symbol, 'mutable default `b=' || CASE t WHEN 5 THEN 'dict()' ELSE '[]' END || '` is shared across calls' AS message WHERE t IN (4, 5, 12)", "'warn'")
_RERAISE = _sql("except.reraise-vs-raise", "SELECT CASE t WHEN 7 THEN 5 ELSE 6 END AS s, CASE t WHEN 7 THEN 5 ELSE 6 END AS e, CAST(NULL AS VARCHAR) AS symbol, '`raise e` truncates traceback; use bare `raise`' AS message WHERE t IN (7, 17)", "'warn'")
_FREE = _sql("test.assertion-free", "SELECT CASE t WHEN 18 THEN 1 ELSE 2 END AS s, CASE t WHEN 18 THEN 2 ELSE 3 END AS e, 'test_a' || k AS symbol, 'test `test_a' || k || '` has no assertion' AS message WHERE t IN (18, 22)")
_TRUE = _sql("test.always-true-assertion", "SELECT l AS s, l AS e, symbol, 'assertion in `' || symbol || '` is trivially true (' || kind || ')' AS message FROM (VALUES (19, 2, 'constant-true', 'test_a' || k), (21, 2, 'self-comparison', 'test_a' || k), (23, 2, 'self-comparison', 'test_a' || k), (25, 2, 'isinstance-object', 'test_a' || k), (26, 2, 'constant-true', 'test_a' || k), (27, 3, 'constant-true', 'test_a' || k), (27, 3, 'constant-true', 'test_b')) x(n, l, kind, symbol) WHERE n = t")
_SLEEP = _sql("test.time.sleep", "SELECT 3 AS s, 3 AS e, 'test_a' || k AS symbol, '`time.sleep(' || k || ')` inside test - flaky signal' AS message WHERE t = 20", "'warn'")
_REINVENT = _sql("ponytail.reinvented", "SELECT CASE t WHEN 9 THEN 3 ELSE 2 END AS s, 5 AS e, CAST(NULL AS VARCHAR) AS symbol, CASE t WHEN 9 THEN 'reinvented sum(); try `total = sum(xs)`' ELSE 'reinvented max(); try `best = max(xs)`' END AS message WHERE t IN (9, 10)")
ALL = " UNION ALL ".join((_MASK, _MUTABLE, _RERAISE, _FREE, _TRUE, _SLEEP, _REINVENT))
WITH = f"WITH {CORPUS} "


def all_findings(spark, sf_dir):
    """Every analyzer over one node table, which is parsed once and written for them."""
    return fnd.analyze(*parsed(spark, sf_dir), ids=False).select(*PLAIN)


def finding_ids(spark, sf_dir):
    return fnd.analyze(*parsed(spark, sf_dir)).select("id", *PLAIN)


def finding_payloads(spark, sf_dir):
    """What ids are digests of, by a digest that SQL has too, for the analyzers of mutable defaults, tracebacks and trivial assertions."""
    found = fnd.analyze(*parsed(spark, sf_dir), ["arg.mutable-default", "except.reraise-vs-raise", "test.always-true-assertion"], ids=False)
    return found.select("file", "start_line", "symbol", F.sha2(finding_payloads_of("analyzer_id", "analyzer_version", "symbol", "file", "evidence"), 256).alias("payload_sha256"))


def parse_error_table(spark, sf_dir):
    """Files that don't parse."""
    return parse_errors(parsed(spark, sf_dir)[0]).select("path", "line")


def file_index_table(spark, sf_dir):
    index = file_index(*parsed(spark, sf_dir))
    return index.select("path", "lines", F.size("symbols").alias("n_symbols"), F.get("symbols", F.lit(0))["name"].alias("first_symbol"))


def severity_summary(spark, sf_dir):
    return fnd.summary(all_findings(spark, sf_dir))


def analyzer_counts(spark, sf_dir):
    return fnd.analyzer_counts(all_findings(spark, sf_dir))


def exit_gate(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    gates = [fnd.exit_code(found, at).select(F.lit(at).alias("at"), "exit_code") for at in fnd.RANK]
    return gates[0].unionAll(gates[1]).unionAll(gates[2])


def symbol_table(spark, sf_dir):
    return symbols(parsed(spark, sf_dir)[0]).drop("repo")


def dup_windows(spark, sf_dir):
    """Five-line windows of documents as of function bodies: clusters of equal text, at most six places listed, collapsed per document."""
    return _document_clusters(spark, sf_dir).select("path", "start_line", "n")


def _document_windows(spark, sf_dir):
    """Windows by two digests of their text, 24 bytes instead of five lines: texts that agree in the first alone stay apart by the second."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("lines"))
    at = docs.where("size(lines) >= 5").select("repo", "path", F.explode(F.expr("sequence(1, size(lines) - 4)")).alias("start_line"), "lines")
    windows = at.select("repo", "path", "start_line", F.array_join(F.expr("slice(lines, start_line, 5)"), "\n").alias("win_text"))
    return windows.select("repo", "path", "start_line", F.unhex(F.md5("win_text")).alias("win"), F.xxhash64("win_text").alias("other"))


BY_DIGEST = ("win", "other")


def _document_clusters(spark, sf_dir, places: bool = False):
    return clusters(_document_windows(spark, sf_dir), BY_DIGEST, places)


def _digest():
    return F.lower(F.hex("win")).alias("win")


def dup_clusters(spark, sf_dir):
    return _document_clusters(spark, sf_dir).where("rank = 1").select(_digest(), "n").distinct()


def dup_collapse(spark, sf_dir):
    return collapse(_document_clusters(spark, sf_dir), BY_DIGEST).select("path", "start_line")


def dup_block(spark, sf_dir):
    """Two long bodies a part, the second with the first's last five lines when the key is even; bodies repeat over parts of one size and type."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    body = F.concat(*[F.concat(F.lit(f"    step{i}("), F.col("p_size").cast("string"), F.lit(", "), F.concat(F.lit("'"), F.substring("p_type", 1, 1), F.lit("'")), F.lit(")\n")) for i in range(6)])
    source = part.select(F.lit("r").alias("repo"), F.concat(F.lit("src/m"), F.col("p_partkey"), F.lit(".py")).alias("path"), F.concat(F.lit("def f():\n    begin"), F.col("p_partkey"), F.lit("()\n"), body).alias("text"))
    source = source.withColumn("content", F.col("text").cast("binary"))
    return REGISTRY["dup.block"].run(node_table(source), source).select("severity", "file", "start_line", "end_line", "message")


def dup_places(spark, sf_dir):
    """The first places of each text that several places have, six at most."""
    found = _document_clusters(spark, sf_dir, places=True).where("rank = 1")
    return found.select(_digest(), "n", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["path"], p["start_line"].cast("string"))), " ").alias("places"))


def mocks_evidence(spark, sf_dir):
    """What findings of tests that mock their own target say of it."""
    found = REGISTRY["test.mocks-target"].run(*paired(spark, sf_dir))
    evidence = F.from_json("evidence", "target_file string, mocked_symbols array<string>")
    return found.select("file", evidence["target_file"].alias("target_file"), F.array_join(evidence["mocked_symbols"], " ").alias("mocked"))


def incremental_findings(spark, sf_dir):
    """Findings of a state's second version: of the tests that the first has seen, those with a key that 5 divides now use both names, and those of the keys after are gone."""
    state, all_files = Incremental(spark, shared_folder(spark, "state")), paired_files(spark, sf_dir)
    key = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    read = lambda rows: rows.select("repo", "path", "text", F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    present = all_files.select("repo", "path", F.lit(1.0).alias("mtime"))
    first = state.apply(read(all_files), present.select("repo", "path", F.lit("added").alias("status")), present, None)
    edited = all_files.where(F.col("path").startswith("tests/test_") & (key % 5 < 2))
    changes = edited.select("repo", "path", F.when(key % 5 == 0, "modified").otherwise("deleted").alias("status"))
    used = F.replace("text", F.lit("    assert load_"), F.concat(F.lit("    save_"), key.cast("string"), F.lit("()\n    assert load_")))
    modified = edited.where(key % 5 == 0).withColumn("text", F.when(key % 3 == 0, F.col("text")).otherwise(used))
    left = present.join(merging(changes.where("status = 'deleted'")), ["repo", "path"], "left_anti")
    now = state.apply(read(modified), changes, left, first)
    return state.findings(now["version"]).select(*PLAIN)


def path_class(spark, sf_dir):
    path = F.col("path")
    return files(spark, sf_dir).select("path", is_non_source(path).alias("non_source"), is_test(path).alias("test_module"), is_named_test(path).alias("named_test"))


def line_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", line_count(F.col("text")).cast("long").alias("lines"))


def normalize_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))))
    return docs.select("doc_id", F.md5(normalized(raw)).alias("digest"))


QUERIES = {
    "all_findings": all_findings, "finding_ids": finding_ids, "finding_payloads": finding_payloads, "parse_errors": parse_error_table, "file_index": file_index_table, "arg_mutable_default": _plain("arg.mutable-default"), "error_masking": _plain("risk.error-masking"), "reraise_vs_raise": _plain("except.reraise-vs-raise"),
    "assertion_free": _plain("test.assertion-free"), "always_true": _plain("test.always-true-assertion"), "time_sleep": _plain("test.time.sleep"), "reinvented_builtin": _plain("ponytail.reinvented"),
    "no_test_for_public": _plain("test.no-test-for-public-symbol", paired), "mocks_target": _plain("test.mocks-target", paired), "severity_summary": severity_summary, "analyzer_counts": analyzer_counts, "exit_gate": exit_gate,
    "symbols": symbol_table, "dup_block": dup_block, "dup_windows": dup_windows, "dup_clusters": dup_clusters, "dup_collapse": dup_collapse, "dup_places": dup_places, "mocks_evidence": mocks_evidence, "incremental_findings": incremental_findings, "path_class": path_class, "line_counts": line_counts, "normalize_text": normalize_text,
}

_WINDOWS = """WITH RECURSIVE l AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(text, chr(10)) AS x FROM documents),
w AS (SELECT path, CAST(i AS INTEGER) AS start_line, array_to_string(x[i:i + 4], chr(10)) AS t FROM (SELECT path, x, unnest(range(1, len(x) - 3)) AS i FROM l)),
d AS (SELECT path, start_line, t, count(*) OVER (PARTITION BY t) AS n FROM w)"""

ORACLES = {
    "all_findings": WITH + ALL, "arg_mutable_default": WITH + _MUTABLE, "error_masking": WITH + _MASK, "reraise_vs_raise": WITH + _RERAISE, "assertion_free": WITH + _FREE, "always_true": WITH + _TRUE, "time_sleep": WITH + _SLEEP, "reinvented_builtin": WITH + _REINVENT,
    "severity_summary": WITH + f"SELECT count(*) FILTER (WHERE severity = 'block') AS block, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info FROM ({ALL})",
    "analyzer_counts": WITH + f"SELECT analyzer_id, count(*) FILTER (WHERE severity = 'block') AS block, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM ({ALL}) GROUP BY analyzer_id",
    "exit_gate": WITH + f", f AS (SELECT max(CASE severity WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS m FROM ({ALL})) SELECT a AS at, CAST(CASE WHEN m >= r THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM f, (VALUES ('info', 0), ('warn', 1), ('block', 2)) v(a, r)",
    "symbols": WITH + """SELECT path, CASE WHEN t >= 18 THEN 'test_a' || k WHEN t = 9 THEN 'C' || k ELSE 'f' || k END AS name, CASE WHEN t = 9 THEN 'class' ELSE 'function' END AS kind,
 CAST(CASE WHEN t IN (20, 22) THEN 2 ELSE 1 END AS INTEGER) AS start_line,
 CAST(CASE WHEN t IN (4, 5, 6, 12, 15, 18, 24, 25, 26) THEN 2 WHEN t IN (19, 21, 22, 23) THEN 3 WHEN t IN (20, 27) THEN 4 WHEN t = 14 THEN 7 WHEN t IN (9, 17) THEN 6 ELSE 5 END AS INTEGER) AS end_line FROM c WHERE t < 28
 UNION ALL SELECT path, 'm', 'method', 2, 6 FROM c WHERE t = 9
 UNION ALL SELECT path, 'test_b', 'function', 2, 3 FROM c WHERE t = 27""",
    "parse_errors": WITH + "SELECT path, 1 AS line FROM c WHERE t = 28",
    "file_index": WITH + """SELECT path, CAST(CASE WHEN t IN (4, 5, 6, 12, 15, 18, 24, 25, 26) THEN 2 WHEN t IN (19, 21, 22, 23) THEN 3 WHEN t IN (20, 27) THEN 4 WHEN t = 14 THEN 7 WHEN t IN (9, 17) THEN 6 ELSE 5 END AS INTEGER) AS lines,
 CASE WHEN t IN (9, 27) THEN 2 ELSE 1 END AS n_symbols, CASE WHEN t >= 18 THEN 'test_a' || k WHEN t = 9 THEN 'C' || k ELSE 'f' || k END AS first_symbol FROM c WHERE t < 28""",
    "finding_payloads": WITH + """, p AS (
 SELECT path AS file, 1 AS start_line, 'b' AS symbol, '{"a": "arg.mutable-default", "e": {"kind": "' || CASE t WHEN 5 THEN 'dict-call' ELSE 'list-literal' END || '", "param": "b", "snippet": "' || CASE t WHEN 5 THEN 'dict()' ELSE '[]' END || '"}, "s": "b", "v": "1"}' AS payload FROM c WHERE t IN (4, 5, 12)
 UNION ALL SELECT path, CASE t WHEN 7 THEN 5 ELSE 6 END, NULL, '{"a": "except.reraise-vs-raise", "e": {"alias": "e", "snippet": "raise e"}, "s": "' || path || '", "v": "1"}' FROM c WHERE t IN (7, 17)
 UNION ALL SELECT path, l, symbol, '{"a": "test.always-true-assertion", "e": {"kind": "' || kind || '", "text": "' || text || '"}, "s": "' || symbol || '", "v": "1"}'
 FROM c, (VALUES (19, 2, 'constant-true', 'a', 'assert True'), (21, 2, 'self-comparison', 'a', 'assert x == x'), (23, 2, 'self-comparison', 'a', 'assert x == x'), (25, 2, 'isinstance-object', 'a', 'assert isinstance(go(x, 1), object)'), (26, 2, 'constant-true', 'a', 'assert f\\"it''s {x}\\"'), (27, 3, 'constant-true', 'a', 'assert 1.5'), (27, 3, 'constant-true', 'b', 'assert 1.5')) x(n, l, kind, who, text), LATERAL (SELECT 'test_' || CASE who WHEN 'a' THEN 'a' || k ELSE 'b' END AS symbol) y WHERE n = t)
 SELECT file, start_line, symbol, sha256(payload) AS payload_sha256 FROM p""",
    "no_test_for_public": """SELECT 'test.no-test-for-public-symbol' AS analyzer_id, 'info' AS severity, 'pkg/mod_' || p_partkey || '.py' AS file, 3 AS start_line, 3 AS end_line, 'save_' || p_partkey AS symbol, 'public `save_' || p_partkey || '` never referenced in tests/test_mod_' || p_partkey || '.py' AS message FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 4 = 1) AND p_partkey % 4 <> 1""",
    "mocks_target": """SELECT 'test.mocks-target' AS analyzer_id, 'warn' AS severity, 'tests/test_mod_' || p_partkey || '.py' AS file, 1 AS start_line, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END AS end_line, 'test_load_' || p_partkey || '_ok' AS symbol, 'test `test_load_' || p_partkey || '_ok` mocks its own target (load_' || p_partkey || ')' AS message FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 <> 0""",
    "dup_windows": _WINDOWS + " SELECT path, start_line, n FROM d WHERE n > 1", "dup_clusters": _WINDOWS + " SELECT DISTINCT md5(t) AS win, n FROM d WHERE n > 1",
    "dup_collapse": _WINDOWS + """, s AS (SELECT DISTINCT path, start_line FROM d WHERE n > 1), f(path, start_line) AS (SELECT path, min(start_line) FROM s GROUP BY path UNION ALL SELECT f.path, (SELECT min(s.start_line) FROM s WHERE s.path = f.path AND s.start_line > f.start_line + 4) FROM f WHERE f.start_line IS NOT NULL)
 SELECT path, start_line FROM f WHERE start_line IS NOT NULL""",
    "dup_block": """WITH g AS (SELECT p_partkey AS k, count(*) OVER (PARTITION BY p_size, p_type[1]) AS n, min('src/m' || p_partkey || '.py') OVER (PARTITION BY p_size, p_type[1]) AS first FROM part)
 SELECT CASE WHEN n > 5 THEN 'info' ELSE 'warn' END AS severity, 'src/m' || k || '.py' AS file, 3 AS start_line, 7 AS end_line, '5+ line block duplicated in ' || n || ' places' || CASE WHEN n > 5 THEN ' (widespread)' ELSE '' END AS message FROM g WHERE n > 1 AND (n <= 5 OR first = 'src/m' || k || '.py')""",
    "dup_places": _WINDOWS + """, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY path, start_line) AS o FROM d WHERE n > 1) SELECT md5(t) AS win, any_value(n) AS n, string_agg(path || ':' || start_line, ' ' ORDER BY path, start_line) AS places FROM r WHERE o <= 6 GROUP BY t""",
    "mocks_evidence": """SELECT 'tests/test_mod_' || p_partkey || '.py' AS file, 'pkg/mod_' || p_partkey || '.py' AS target_file, 'load_' || p_partkey AS mocked FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 <> 0""",
    "incremental_findings": """SELECT 'test.no-test-for-public-symbol' AS analyzer_id, 'info' AS severity, 'pkg/mod_' || p_partkey || '.py' AS file, 3 AS start_line, 3 AS end_line, 'save_' || p_partkey AS symbol, 'public `save_' || p_partkey || '` never referenced in tests/test_mod_' || p_partkey || '.py' AS message FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 4 = 1) AND p_partkey % 4 <> 1 AND p_partkey % 5 > 1
 UNION ALL SELECT 'test.mocks-target', 'warn', 'tests/test_mod_' || p_partkey || '.py', 1, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 4 ELSE 3 END, 'test_load_' || p_partkey || '_ok', 'test `test_load_' || p_partkey || '_ok` mocks its own target (load_' || p_partkey || ')' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 <> 0 AND p_partkey % 5 <> 1""",
    "path_class": WITH + "SELECT path, aside AS non_source, t >= 18 AS test_module, t >= 18 AS named_test FROM c",
    "line_counts": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS lines FROM documents",
    "normalize_text": "SELECT doc_id, md5(text) AS digest FROM documents",
}
