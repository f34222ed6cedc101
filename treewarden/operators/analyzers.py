"""The ten analyzers, each a function of fact tables to findings without ids.

``nodes`` is the node table, ``files`` has repo, path and normalised text. Everything is joined within (repo, path); joins with what
lies in a subtree are equi-joins on the file and the numbers of the owners that the parser found open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import content_hash, short_hash
from ..functions.paths import basename, is_named_test, is_non_source, is_test
from ..functions.scratch import merging
from ..functions.text import line_count

FILE = ["repo", "path"]
COLUMNS = ["repo", "analyzer_id", "analyzer_version", "severity", "file", "start_line", "end_line", "symbol", "message", "evidence"]


@dataclass(frozen=True)
class Keyed:
    """A cross-file analyzer in three steps, so that a change is judged by the keys it touches.

    ``facts`` (nodes, files) has rows of each file by itself, with repo, path and key. ``judge`` makes rows with repo, path and key of facts; those of a key
    follow from the facts of that key alone. ``settle`` makes findings of them, each file's from that file's rows alone.
    """

    facts: Callable[[DataFrame, DataFrame], DataFrame]
    judge: Callable[[DataFrame], DataFrame]
    settle: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Analyzer:
    id: str
    version: str
    cross_file: bool
    run: Callable[[DataFrame, DataFrame], DataFrame]
    keyed: Keyed | None = None
    tests_only: bool = False

    def finish(self, found: DataFrame) -> DataFrame:
        """Rows of severity, start, end, symbol, message and evidence as findings without ids."""
        return found.select("repo", F.lit(self.id).alias("analyzer_id"), F.lit(self.version).alias("analyzer_version"), "severity", F.col("path").alias("file"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("symbol").cast("string").alias("symbol"), "message", F.to_json("evidence").alias("evidence"))


REGISTRY: dict[str, Analyzer] = {}


def register(id: str, version: str, cross_file: bool = False, tests_only: bool = False):
    """Adds a function (nodes, files) -> rows of severity, file, start_line, end_line, symbol, message and evidence (a struct) with repo. ``tests_only``: it looks at test modules alone."""

    def add(f):
        REGISTRY[id] = Analyzer(id, version, cross_file, lambda nodes, files: REGISTRY[id].finish(f(nodes, files)), tests_only=tests_only)
        return f

    return add


def register_keyed(id: str, version: str, keyed: Keyed) -> None:
    """Adds a cross-file analyzer that can be kept up by the keys that a change touches."""
    REGISTRY[id] = Analyzer(id, version, True, lambda nodes, files: REGISTRY[id].finish(keyed.settle(keyed.judge(keyed.facts(nodes, files)))), keyed)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _tests(nodes: DataFrame) -> DataFrame:
    """Test functions of test modules, as owners of their subtree."""
    fn = nodes.where((F.col("type") == "function_definition") & F.col("text").startswith("test_"))
    return fn.select(*FILE, F.col("id").alias("fn"), F.col("last").alias("fn_last"), F.col("text").alias("name"), F.col("start").alias("fn_start"), F.col("end").alias("fn_end"))


def _inside(owners: DataFrame, found: DataFrame, owner: str, how: str = "inner") -> DataFrame:
    """Joins each owner with what lies in its subtree. The parser has kept a stack of open owners, so each row of ``found`` names those around it (owners) and meets them by their number."""
    f = found.select("*", F.explode("owners").alias(owner)).drop("owners")
    return owners.join(merging(f), [*FILE, owner], how)


def _tail(callee: Column) -> Column:
    return F.element_at(F.split(callee, r"\."), -1)


@register("risk.error-masking", "2")
def error_masking(nodes: DataFrame, files: DataFrame) -> DataFrame:
    clause = nodes.where("type = 'except_clause'").select(*FILE, F.col("id").alias("clause"), "start", "end", "source")
    child = nodes.where("role IN ('body', 'type', 'alias')").select(*FILE, F.col("parent").alias("clause"), "id", "last", "role", "type", "ordinal")
    # a bare ... is an expression statement with an ellipsis below
    ellipsis = nodes.where("type = 'ellipsis'").select(*FILE, F.col("parent").alias("id"), F.lit(True).alias("dots"))
    parts = child.join(merging(ellipsis), [*FILE, "id"], "left").join(merging(clause.select(*FILE, "clause")), [*FILE, "clause"], "left_semi")
    noop = (F.col("type") == "pass_statement") | ((F.col("type") == "expression_statement") & F.coalesce("dots", F.lit(False)))
    body = parts.groupBy(*FILE, "clause").agg(
        F.count_if(F.col("role") == "body").alias("n"), F.count_if((F.col("role") == "body") & ~noop).alias("busy"),
        F.max_by(F.struct("id", "last"), F.when(F.col("role") != "body", F.struct(F.col("type") == "comment", F.col("role") != "alias", "ordinal"))).alias("spec"), F.max(F.when(F.col("role") == "alias", F.col("id"))).alias("alias"),
    ).where("n > 0 AND busy = 0")
    spec = body.select(*FILE, "clause", F.col("spec.id").alias("spec"), F.col("spec.last").alias("spec_last"), "alias")
    names = nodes.where("type = 'identifier' AND text IN ('Exception', 'BaseException') OR type = 'attribute' AND (text LIKE '%.Exception' OR text LIKE '%.BaseException')").select(*[F.col(c).alias(f"_{c}") for c in FILE], "id")
    broad = spec.join(merging(names), (F.col("repo") == F.col("_repo")) & (F.col("path") == F.col("_path")) & ((F.col("id") >= F.col("spec")) & (F.col("id") <= F.col("spec_last")) | (F.col("id") == F.col("alias"))), "left")
    kinds = broad.groupBy(*FILE, "clause").agg(F.when(F.max("spec").isNull(), "bare-except").when(F.max("id").isNotNull(), "broad-except").otherwise("specific-except").alias("kind"))
    severity = F.when((F.col("kind") == "specific-except") | is_non_source(F.col("path")), "info").otherwise("warn")
    return clause.join(merging(kinds), [*FILE, "clause"]).select("repo", "path", "start", "end", F.lit(None).alias("symbol"), severity.alias("severity"), _text("except clause swallows errors (", F.col("kind"), ")").alias("message"), F.struct("kind", F.col("source").alias("snippet")).alias("evidence"))


@register("arg.mutable-default", "1")
def mutable_default(nodes: DataFrame, files: DataFrame) -> DataFrame:
    parameter = nodes.where("type = 'default_parameter'").select(*FILE, F.col("id").alias("parent"), F.col("text").alias("param"), "start", "end")
    value = nodes.where("role = 'value'").select(*FILE, "parent", "type", "text", "source")
    kind = F.expr("CASE type WHEN 'list' THEN 'list-literal' WHEN 'dictionary' THEN 'dict-literal' WHEN 'set' THEN 'set-literal' WHEN 'call' THEN CASE text WHEN 'list' THEN 'list-call' WHEN 'dict' THEN 'dict-call' WHEN 'set' THEN 'set-call' END END")
    snippet = F.expr("CASE kind WHEN 'list-literal' THEN '[]' WHEN 'dict-literal' THEN '{}' WHEN 'set-literal' THEN source ELSE concat(text, '()') END")
    found = parameter.join(merging(value), [*FILE, "parent"]).withColumn("kind", kind).where("kind IS NOT NULL").withColumn("snippet", snippet)
    return found.select("repo", "path", "start", "end", F.col("param").alias("symbol"), F.lit("warn").alias("severity"), _text("mutable default `", F.col("param"), "=", F.col("snippet"), "` is shared across calls").alias("message"), F.struct("kind", "param", "snippet").alias("evidence"))


@register("except.reraise-vs-raise", "1")
def reraise(nodes: DataFrame, files: DataFrame) -> DataFrame:
    clause = nodes.where("type = 'except_clause'").select(*FILE, F.col("id").alias("clause"), F.col("last").alias("clause_last"))
    alias = nodes.where("role = 'alias'").select(*FILE, F.col("parent").alias("clause"), F.col("text").alias("alias"))
    only = nodes.where("type = 'identifier' AND role = 'exc'").select(*FILE, F.col("parent").alias("id"), F.col("text").alias("raised"))
    raises = nodes.where("type = 'raise_statement' AND children = 1").select(*FILE, "id", "start", "end", "source", "owners").join(merging(only), [*FILE, "id"])
    found = _inside(clause.join(merging(alias), [*FILE, "clause"]), raises, "clause").where("raised = alias")
    last = found.groupBy(*FILE, "clause").agg(F.max_by(F.struct("start", "end", "alias", F.col("source").alias("snippet")), "id").alias("r"))
    return last.select("repo", "path", "r.start", "r.end", F.lit(None).alias("symbol"), F.lit("warn").alias("severity"), _text("`raise ", F.col("r.alias"), "` truncates traceback; use bare `raise`").alias("message"), F.struct("r.alias", "r.snippet").alias("evidence"))


@register("test.assertion-free", "2", tests_only=True)
def assertion_free(nodes: DataFrame, files: DataFrame) -> DataFrame:
    call, tail = F.col("type") == "call", _tail(F.col("text"))
    asserts = nodes.where((F.col("type") == "assert_statement") | call & (tail.startswith("assert") | (tail == "fail") | F.col("text").endswith("pytest.raises") | F.col("text").endswith("pytest.warns"))).select(*FILE, "owners")
    found = _inside(_tests(nodes.where(is_test(F.col("path")))), asserts, "fn", "left_anti")
    return found.select("repo", "path", F.col("fn_start").alias("start"), F.col("fn_end").alias("end"), F.col("name").alias("symbol"), F.lit("info").alias("severity"), _text("test `", F.col("name"), "` has no assertion").alias("message"), F.struct(F.col("name").alias("function")).alias("evidence"))


def _always_true(nodes: DataFrame) -> DataFrame:
    """(repo, path, id, kind) of expressions that are true whatever the code does."""
    literal = (
        F.when(F.lower("source").isin("true", "1", "-1"), "constant-true")
        .when((F.col("type") == "integer") & ~F.col("source").isin("0", "0x0", "0o0", "0b0"), "constant-true")
        .when((F.col("type") == "float") & (F.regexp_replace("source", "_", "").try_cast("double") != 0), "constant-true")
        .when((F.col("type") == "string") & F.col("source").rlike(r"(?s)^[A-Za-z]*(\"\"\".+\"\"\"|'''.+'''|\"[^\"].*\"|'[^'].*')$"), "constant-true")
    )
    simple = nodes.where("source IS NOT NULL").select(*FILE, "id", literal.alias("kind")).where("kind IS NOT NULL")
    names = nodes.where("type = 'identifier'").select(*FILE, F.col("parent").alias("id"), "text")
    compared = nodes.where("type = 'comparison_operator' AND children = 2").select(*FILE, "id")
    same = names.join(merging(compared), [*FILE, "id"], "left_semi").groupBy(*FILE, "id").agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b")).where("n = 2 AND a = b").select(*FILE, "id", F.lit("self-comparison").alias("kind"))
    # isinstance with two arguments, object the second
    given = nodes.where("role IN ('args', 'keywords')").select(*FILE, F.col("parent").alias("id"), "role", "ordinal", "source")
    calls = nodes.where("type = 'call' AND text = 'isinstance'").select(*FILE, "id").join(merging(given), [*FILE, "id"]).groupBy(*FILE, "id").agg(F.count("*").alias("n"), F.max_by("source", "ordinal").alias("second"))
    calls = calls.where("n = 2 AND second = 'object'").select(*FILE, "id", F.lit("isinstance-object").alias("kind"))
    return simple.unionByName(same).unionByName(calls)


@register("test.always-true-assertion", "1", tests_only=True)
def always_true(nodes: DataFrame, files: DataFrame) -> DataFrame:
    nodes = nodes.where(is_test(F.col("path")))
    true = _always_true(nodes)
    tested = nodes.where("type = 'assert_statement'").select(*FILE, "id", "start", "end", "rpre", "source", "owners").join(merging(nodes.where("role = 'test'").select(*FILE, F.col("parent").alias("id"), F.col("id").alias("arg"))), [*FILE, "id"])
    calls = nodes.where("type = 'call'").withColumn("tail", _tail(F.col("text")))
    args = nodes.where("role = 'args'").select(*FILE, F.col("parent").alias("id"), F.col("id").alias("arg"), "type", F.col("source").alias("arg_source"), "ordinal")
    first = args.groupBy(*FILE, "id").agg(F.min_by(F.struct("arg", "arg_source"), "ordinal").alias("a0"), F.sort_array(F.collect_list(F.struct("ordinal", "type", "arg_source"))).alias("all"))
    calls = calls.select(*FILE, "id", "start", "end", "rpre", "source", "owners", "tail").join(merging(first), [*FILE, "id"])
    by_arg = tested.unionByName(calls.where("tail IN ('assertTrue', 'assert_')").select(*tested.columns[:-1], F.col("a0.arg").alias("arg")))
    found = by_arg.join(merging(true.withColumnRenamed("id", "arg")), [*FILE, "arg"]).drop("arg")
    false = calls.where("tail = 'assertFalse' AND lower(a0.arg_source) IN ('false', '0', '0.0', '\"\"', \"''\")").withColumn("kind", F.lit("constant-false"))
    equal = calls.where("tail IN ('assertEqual', 'assertEquals', 'assertIs') AND size(all) >= 2 AND all[0].type = 'identifier' AND all[1].type = 'identifier' AND all[0].arg_source = all[1].arg_source").withColumn("kind", F.lit("self-comparison"))
    found = found.unionByName(false.select(found.columns)).unionByName(equal.select(found.columns))
    within = _inside(_tests(nodes), found, "fn")
    order = Window.partitionBy(*FILE, "fn", "start").orderBy("rpre")
    one = within.withColumn("n", F.row_number().over(order)).where("n = 1")
    return one.select("repo", "path", "start", "end", F.col("name").alias("symbol"), F.lit("info").alias("severity"), _text("assertion in `", F.col("name"), "` is trivially true (", F.col("kind"), ")").alias("message"), F.struct("kind", F.substring("source", 1, 200).alias("text")).alias("evidence"))


@register("test.time.sleep", "1", tests_only=True)
def time_sleep(nodes: DataFrame, files: DataFrame) -> DataFrame:
    imports = F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+time\s+import\s+([^\n]+)"), 1)
    bare = files.where(F.exists(imports, lambda s: F.array_contains(F.split(s, r"[,\s()]+"), "sleep"))).select(*FILE, F.lit(True).alias("bare"))
    calls = nodes.where(is_test(F.col("path")) & (F.col("type") == "call") & F.col("text").isin("time.sleep", "sleep")).join(merging(bare), FILE, "left").where("text = 'time.sleep' OR bare")
    found = _inside(_tests(nodes.where(is_test(F.col("path")))), calls.select(*FILE, "start", "end", "text", "source", "owners"), "fn")
    return found.select("repo", "path", "start", "end", F.col("name").alias("symbol"), F.lit("warn").alias("severity"), _text("`", F.col("source"), "` inside test - flaky signal").alias("message"), F.struct(F.col("text").alias("kind"), F.col("source").alias("snippet")).alias("evidence"))


@register("ponytail.reinvented", "1")
def reinvented(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """A seed right before a loop that builds a sum or a maximum."""
    block = Window.partitionBy(*FILE, "parent", "role").orderBy("ordinal")
    statements = nodes.where("role IN ('body', 'orelse', 'finalbody')").withColumn("seed", F.lag(F.struct("id", "type", "start")).over(block))
    loops = statements.where("type = 'for_statement' AND seed.type = 'assignment'").select(*FILE, F.col("id").alias("loop"), F.col("seed.id").alias("seed"), F.col("seed.start").alias("start"), "end")
    part = lambda role, parent, name: nodes.where(f"role = '{role}'").select(*FILE, F.col("parent").alias(parent), F.col("id").alias(f"{name}_id"), F.col("type").alias(f"{name}_type"), F.col("text").alias(f"{name}"), F.col("source").alias(f"{name}_source"))
    single = nodes.where("role = 'body'").groupBy(*FILE, F.col("parent").alias("loop")).agg(F.count("*").alias("n"), F.min_by(F.struct("id", "type", "text"), "ordinal").alias("s")).where("n = 1").select(*FILE, "loop", F.col("s.id").alias("stmt"), F.col("s.type").alias("stmt_type"), F.col("s.text").alias("stmt_text"))
    head = loops.join(merging(part("targets", "seed", "acc")), [*FILE, "seed"]).join(merging(part("value", "seed", "init")), [*FILE, "seed"]).join(merging(part("target", "loop", "var")), [*FILE, "loop"]).join(merging(part("iter", "loop", "iter")), [*FILE, "loop"]).join(merging(single), [*FILE, "loop"]).where("acc_type = 'identifier' AND var_type = 'identifier'")
    sums = head.where("init_source = '0' AND stmt_type = 'augmented_assignment' AND stmt_text = 'Add'").join(merging(part("target", "stmt", "left")), [*FILE, "stmt"]).join(merging(part("value", "stmt", "right")), [*FILE, "stmt"]).where("left_type = 'identifier' AND right_type = 'identifier' AND left = acc AND right = var").withColumn("kind", F.lit("sum"))
    tests = head.where("init_source = concat(iter_source, '[0]') AND stmt_type = 'if_statement'").join(merging(part("test", "stmt", "cond")), [*FILE, "stmt"]).where("cond = 'Gt'")
    inner = nodes.where("role = 'body'").groupBy(*FILE, F.col("parent").alias("stmt")).agg(F.count("*").alias("k"), F.min_by(F.struct("id", "type"), "ordinal").alias("i")).where("k = 1 AND i.type = 'assignment'").select(*FILE, "stmt", F.col("i.id").alias("inner"))
    above = part("left", "cond_id", "l").join(merging(part("comparators", "cond_id", "r")), [*FILE, "cond_id"])
    maxes = tests.join(merging(above), [*FILE, "cond_id"]).where("l = var AND r = acc").join(merging(inner), [*FILE, "stmt"]).join(merging(part("targets", "inner", "left")), [*FILE, "inner"]).join(merging(part("value", "inner", "right")), [*FILE, "inner"]).where("left = acc AND right = var").withColumn("kind", F.lit("max"))
    columns = [*FILE, "start", "end", "acc", "iter_source", "kind"]
    found = sums.select(columns).unionByName(maxes.select(columns)).withColumn("replacement", _text(F.col("acc"), " = ", F.col("kind"), "(", F.col("iter_source"), ")"))
    return found.select("repo", "path", "start", "end", F.lit(None).alias("symbol"), F.lit("info").alias("severity"), _text("reinvented ", F.col("kind"), "(); try `", F.col("replacement"), "`").alias("message"), F.struct("kind", "replacement", F.col("iter_source").alias("iterable")).alias("evidence"))


def symbols(nodes: DataFrame) -> DataFrame:
    """Functions, classes and methods; a function below a class, at any depth, is a method, which the parser tells."""
    kind = F.when(F.col("type") == "class_definition", "class").when(F.col("method"), "method").otherwise("function")
    return nodes.where("type IN ('function_definition', 'class_definition')").select(*FILE, F.col("text").alias("name"), kind.alias("kind"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))


def file_index(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """A row a file that parses: content hash, lines, and its symbols by first line and name."""
    listed = symbols(nodes).groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "kind", "end_line"))).alias("symbols"))  # one file's
    parsed = files.join(merging(nodes.where("type = 'parse_error'").select(*FILE)), FILE, "left_anti")
    rows = parsed.select(*FILE, content_hash("content").alias("content_hash"), line_count(F.col("text")).cast("int").alias("lines"))
    return rows.join(merging(listed), FILE, "left").withColumn("symbols", F.coalesce("symbols", F.array().cast(listed.schema["symbols"].dataType)))


def _public_facts(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """By the name of the module that is tested: public names of modules, and of each test file the words it holds. Texts go no further."""
    path, name = F.col("path"), basename(F.col("path"))
    sources = files.where(~is_non_source(path) & path.endswith(".py") & (name != "__init__.py") & ~name.startswith("_")).select(*FILE, name.alias("key"))
    public = symbols(nodes).where("kind IN ('function', 'class') AND NOT startswith(name, '_')").join(merging(sources), FILE)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)"), 1))
    tests = files.where(name.startswith("test_")).select(*FILE, F.substring(name, 6, 1 << 20).alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), words.alias("words"))
    return public.select(*FILE, "key", "name", F.col("start_line").alias("line"), F.lit(None).cast("array<string>").alias("words")).unionByName(tests)


def _untested(facts: DataFrame) -> DataFrame:
    """A name is mentioned if it is a word of any test of its module's name: a hash anti-join over words."""
    by = ["repo", "key"]
    tests, public = facts.where("name IS NULL"), facts.where("name IS NOT NULL")
    lists = tests.groupBy(*by).agg(F.sort_array(F.collect_set("path")).alias("test_files"))
    words = tests.select(*by, F.explode("words").alias("name")).distinct()
    return public.join(merging(words), [*by, "name"], "left_anti").join(merging(lists), by).select(*FILE, "key", "name", "line", "test_files")


def _untested_found(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "path", F.col("line").alias("start"), F.col("line").alias("end"), F.col("name").alias("symbol"), F.lit("info").alias("severity"), _text("public `", F.col("name"), "` never referenced in ", F.col("test_files")[0]).alias("message"), F.struct("test_files").alias("evidence"))


register_keyed("test.no-test-for-public-symbol", "1", Keyed(_public_facts, _untested, _untested_found))


def _patch_facts(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """By the name of the module that is tested: what test functions patch, and the functions and classes of each module."""
    path = F.col("path")
    calls = nodes.where(is_named_test(path) & (F.col("type") == "call") & (F.col("text").endswith("patch.object") | (F.col("text") == "patch") | F.col("text").endswith(".patch"))).select(*FILE, "id", "owners")
    strings = nodes.where("type = 'string' AND role = 'args'").select(*FILE, F.col("parent").alias("id"), "ordinal", "source").groupBy(*FILE, "id").agg(F.min_by("source", "ordinal").alias("source"))
    bare = F.regexp_replace("source", r"^[A-Za-z]*(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "")
    patched = calls.join(merging(strings), [*FILE, "id"]).select(*FILE, "id", "owners", F.element_at(F.split(bare, r"\."), -1).alias("patched"))
    within = _inside(_tests(nodes.where(is_named_test(path))), patched, "fn").select(*FILE, F.substring(basename(path), 6, 1 << 20).alias("key"), F.struct("fn", "name", "fn_start", "fn_end", "patched").alias("patch"), F.lit(None).cast("array<string>").alias("own"))
    own = symbols(nodes).where("kind IN ('function', 'class')").groupBy(*FILE).agg(F.collect_set("name").alias("own"))  # one file's
    targets = files.where(~basename(path).startswith("test_")).select(*FILE, basename(path).alias("key")).join(merging(own), FILE, "left")
    return within.unionByName(targets.select(*FILE, "key", F.lit(None).cast(within.schema["patch"].dataType).alias("patch"), F.coalesce("own", F.array().cast("array<string>")).alias("own")))


def _mocked(facts: DataFrame) -> DataFrame:
    """Of the files named like the test without its prefix the one that shares most leading folders is its target."""
    by = ["repo", "key"]
    tests = facts.where("patch IS NOT NULL").select(*FILE, "key", "patch.*")
    targets = facts.where("patch IS NULL").select(*by, F.col("path").alias("target"), "own")
    a, b = F.split("path", "/"), F.split("target", "/")
    same = F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(b, 1, F.size(b) - 1), lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))
    places = tests.select(*FILE, "key").distinct().join(merging(targets.select(*by, "target")), by)
    nearest = places.groupBy(*FILE, "key").agg(F.min_by("target", F.struct(-shared, F.length("target"), "target")).alias("target"))
    own = targets.select(*by, "target", F.explode("own").alias("patched"))
    hits = tests.join(merging(nearest), [*FILE, "key"]).join(merging(own), [*by, "target", "patched"])
    tail, sut = F.substring("name", 6, 1 << 20), F.lower("patched")
    hits = hits.where((F.lower(tail) == sut) | F.lower(tail).startswith(F.concat(sut, F.lit("_"))))
    return hits.groupBy(*FILE, "key", "fn", "name", "fn_start", "fn_end", "target").agg(F.sort_array(F.collect_set("patched")).alias("mocked_symbols"))


def _mocked_found(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "path", F.col("fn_start").alias("start"), F.col("fn_end").alias("end"), F.col("name").alias("symbol"), F.lit("warn").alias("severity"), _text("test `", F.col("name"), "` mocks its own target (", F.array_join("mocked_symbols", ", "), ")").alias("message"), F.struct(F.col("target").alias("target_file"), "mocked_symbols").alias("evidence"))


register_keyed("test.mocks-target", "2", Keyed(_patch_facts, _mocked, _mocked_found))


WINDOW, MOST_PLACES, STRING_SHARE = 5, 5, 0.6


def _merged_strings(nodes: DataFrame) -> DataFrame:
    """Per file the spans of string literals in order, with the bytes of literals before each; literals of one file don't overlap but where one lies in another's braces, so runs of overlapping ones are kept as their edges and how many are open after each."""
    edge = F.explode(F.array(F.struct(F.col("start_byte").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_byte").alias("at"), F.lit(-1).alias("d"))))
    edges = nodes.where("type = 'string'").select(*FILE, edge.alias("e")).select(*FILE, "e.at", "e.d").groupBy(*FILE, "at").agg(F.sum("d").alias("d"))
    in_order = Window.partitionBy(*FILE).orderBy("at")
    open_ = edges.withColumn("open", F.sum("d").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("at").over(in_order)).withColumn("was", F.lag("open", 1, 0).over(in_order))
    filled = open_.withColumn("filled", F.sum(F.coalesce((F.col("at") - F.col("before")) * F.col("was"), F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.select(*FILE, "at", F.col("filled").cast("long").alias("filled"), F.col("open").cast("long").alias("open"))


def _filled_to(places: DataFrame, strings: DataFrame, at: str) -> DataFrame:
    """places (repo, path, <at>) with ``filled``: bytes of literals before it. Both are merged in order of places and each takes the last edge at or before it."""
    both = places.select(*FILE, at).distinct().select(*FILE, F.col(at).alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("struct<at:bigint,filled:bigint,open:bigint>").alias("edge"))
    both = both.unionByName(strings.select(*FILE, "at", F.lit(0).alias("asked"), F.struct("at", "filled", "open").alias("edge")))
    in_order = Window.partitionBy(*FILE).orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("edge", F.last("edge", ignorenulls=True).over(in_order)).where("asked = 1")
    return last.select(*FILE, F.col("at").alias(at), F.coalesce(F.col("edge.filled") + F.col("edge.open") * (F.col("at") - F.col("edge.at")), F.lit(0)).alias("filled"))


def windows(nodes: DataFrame) -> DataFrame:
    """Five-line windows of function bodies that say enough: three lines with text, three different ones, and not mostly string literals.

    The bytes of literals in a window are those before its end less those before its begin, which one sweep over the file's edges of literals and borders of windows tells.
    """
    fn = nodes.where("type = 'function_definition'").select(*FILE, "id", "lines", "offsets")
    at = fn.where(F.size("lines") >= WINDOW).select("*", F.explode(F.sequence(F.lit(1), F.size("lines") - WINDOW + 1)).alias("i"))
    at = at.select(*FILE, (F.col("offsets")[0] + F.col("i") - 1).cast("int").alias("start_line"), F.slice("lines", F.col("i"), WINDOW).alias("w"), F.col("offsets")[F.col("i")].alias("from"), F.col("offsets")[F.col("i") + WINDOW].alias("to"))
    full = F.filter(F.transform("w", lambda x: F.trim(F.regexp_replace(x, r"^\s+", ""))), lambda x: x != "")
    kept = at.where((F.size(full) >= 3) & (F.size(F.array_distinct(full)) >= 3)).select(*FILE, "start_line", F.array_join("w", "\n").alias("win_text"), "from", "to").distinct()
    borders = kept.select(*FILE, F.explode(F.array("from", "to")).alias("at"))
    filled = _filled_to(borders, _merged_strings(nodes), "at")
    side = lambda name: filled.select(*FILE, F.col("at").alias(name), F.col("filled").alias(f"{name}_filled"))
    both = kept.join(merging(side("from")), [*FILE, "from"]).join(merging(side("to")), [*FILE, "to"])
    return both.where(F.col("to_filled") - F.col("from_filled") < STRING_SHARE * (F.col("to") - F.col("from"))).select(*FILE, "start_line", "win_text").distinct()


def clusters(found: DataFrame, by: tuple[str, ...] = ("win_text",), places: bool = True) -> DataFrame:
    """Windows (repo, path, start_line, win_text) whose text occurs twice or more, with their number, rank 1 for the first place, and the first MOST_PLACES + 1 places. Numbers and places are taken in each task first.

    Every window is shuffled with the columns that stand for its text (``by``), so digests weigh less than texts. Without ``places`` those aren't listed.
    """
    text = ["repo", *by]
    counted = found.groupBy(*text).agg(F.count("*").alias("n"), F.min(F.struct("path", "start_line")).alias("first")).where("n > 1")
    several = found.join(merging(counted), text).withColumn("rank", F.when(F.struct("path", "start_line") == F.col("first"), 1).otherwise(2)).drop("first")
    if not places:
        return several
    order = Window.partitionBy(*text).orderBy("path", "start_line")
    first = several.select(*text, "path", "start_line").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MOST_PLACES + 1)
    return several.join(merging(first.groupBy(*text).agg(F.sort_array(F.collect_list(F.struct("path", "start_line"))).alias("places"))), text)


def collapse(raw: DataFrame, by: tuple[str, ...] = ("win_text",)) -> DataFrame:
    """Per file, by start line: a finding that begins within the last one that was kept goes; of several that begin on a line the one first in the order of ``by`` stays. One pass over each task's starts in order remembers nothing but the last one kept."""
    starts = raw.select(*FILE, "start_line").distinct().repartition(*FILE).sortWithinPartitions(*FILE, "start_line")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, last = None, 0
        for batch in batches:
            keep = []
            for repo, path, at in zip(*(batch.column(c).to_pylist() for c in (*FILE, "start_line")), strict=True):
                if (repo, path) != file or at > last:
                    file, last = (repo, path), at + WINDOW - 1
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    first = starts.mapInArrow(kept, starts.schema)
    tie = Window.partitionBy(*FILE, "start_line").orderBy(*by)
    return raw.join(merging(first), [*FILE, "start_line"]).withColumn("tie", F.row_number().over(tie)).where("tie = 1").drop("tie")


def _window_facts(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return windows(nodes).withColumn("key", F.xxhash64("win_text"))


def _duplicated(facts: DataFrame) -> DataFrame:
    return clusters(facts.drop("key")).where(f"n <= {MOST_PLACES} OR rank = 1").withColumn("key", F.xxhash64("win_text"))


def _duplicated_found(rows: DataFrame) -> DataFrame:
    raw = collapse(rows).withColumn("window_hash", short_hash("win_text"))
    span = lambda p: F.struct(p["path"].alias("file"), F.array(p["start_line"], p["start_line"] + WINDOW - 1).alias("span"))
    others = F.transform(F.filter("places", lambda p: (p["path"] != F.col("path")) | (p["start_line"] != F.col("start_line"))), span)
    wide = F.col("n") > MOST_PLACES
    evidence = F.struct("window_hash", F.when(wide, F.col("n")).alias("total_matches"), others.alias("matches"))
    message = _text(f"{WINDOW}+ line block duplicated in ", F.col("n").cast("string"), " places", F.when(wide, " (widespread)").otherwise(""))
    severity = F.when(wide | is_non_source(F.col("path")), "info").otherwise("warn")
    return raw.select("repo", "path", F.col("start_line").alias("start"), (F.col("start_line") + WINDOW - 1).alias("end"), F.lit(None).alias("symbol"), severity.alias("severity"), message.alias("message"), evidence.alias("evidence"))


register_keyed("dup.block", "5", Keyed(_window_facts, _duplicated, _duplicated_found))
