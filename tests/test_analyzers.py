import hashlib
import json

import pytest


@pytest.mark.parametrize(
    ("body", "kind", "severity"),
    [("except:\n        pass", "bare-except", "warn"), ("except Exception as e:\n        ...", "broad-except", "warn"), ("except (Exception, OSError):\n        pass", "broad-except", "warn"), ("except ValueError:\n        pass", "specific-except", "info"), ("except Exception:\n        log()", None, None), ("except ValueError:\n        'text'", None, None)],
)
def test_error_masking(run, body, kind, severity):
    found = run("risk.error-masking", {"src/a.py": f"def f():\n    try:\n        go()\n    {body}\n"})
    assert [(json.loads(r["evidence"])["kind"], r["severity"]) for r in found] == ([(kind, severity)] if kind else [])


def test_error_masking_in_tests_is_info(run):
    assert run("risk.error-masking", {"tests/test_x.py": "try:\n    go()\nexcept:\n    pass\n"})[0]["severity"] == "info"


def test_mutable_default(run):
    found = run("arg.mutable-default", {"a.py": "def f(a, b=[], c={}, d={1, 2}, e=list(), f=None, g=(1,), h: list = []):\n    pass\nx = lambda q=[]: q\n"})
    assert sorted((r["symbol"], json.loads(r["evidence"])["snippet"]) for r in found) == [("b", "[]"), ("c", "{}"), ("d", "{1, 2}"), ("e", "list()"), ("q", "[]")]


def test_reraise_takes_the_last(run):
    found = run("except.reraise-vs-raise", {"a.py": "try:\n    go()\nexcept ValueError as e:\n    if x:\n        raise e\n    raise e\n", "b.py": "try:\n    go()\nexcept E as e:\n    raise X from e\n", "c.py": "try:\n    go()\nexcept E as e:\n    raise\n"})
    assert [(r["file"], r["start_line"]) for r in found] == [("a.py", 6)]


def test_assertion_free(run):
    source = "def test_empty():\n    go()\ndef test_a():\n    assert x\ndef test_b(self):\n    self.assertEqual(1, 2)\ndef test_c():\n    with pytest.raises(E):\n        go()\ndef helper():\n    go()\n"
    assert [r["symbol"] for r in run("test.assertion-free", {"tests/test_x.py": source, "tests/data/test_y.py": source, "src/x.py": source})] == ["test_empty"]


def test_always_true(run):
    source = "def test_t(self, x, s):\n    assert True\n    assert x == x\n    assert isinstance(s, object)\n    self.assertTrue(True)\n    assert go() == 1\n    assert 0\n    assert 'text'\n    self.assertEqual(x, x)\n    self.assertFalse(False)\n"
    found = run("test.always-true-assertion", {"test_x.py": source, "x.py": source})
    assert [(r["start_line"], json.loads(r["evidence"])["kind"]) for r in found] == [(2, "constant-true"), (3, "self-comparison"), (4, "isinstance-object"), (5, "constant-true"), (8, "constant-true"), (9, "self-comparison"), (10, "constant-false")]


def test_time_sleep(run):
    found = run("test.time.sleep", {"test_a.py": "import time\ndef test_a():\n    if x:\n        time.sleep(1)\ndef helper():\n    time.sleep(1)\n", "test_b.py": "from time import sleep\ndef test_b():\n    sleep(2)\n", "test_c.py": "def test_c():\n    sleep(2)\n"})
    assert [(r["file"], r["start_line"]) for r in found] == [("test_a.py", 4), ("test_b.py", 3)]


def test_reinvented(run):
    found = run("ponytail.reinvented", {"a.py": "def f(xs):\n    total = 0\n    for x in xs:\n        total += x\n    best = xs[0]\n    for x in xs:\n        if x > best:\n            best = x\n    other = 1\n    for x in xs:\n        other += x\n    late = 0\n    go()\n    for x in xs:\n        late += x\n"})
    assert [(json.loads(r["evidence"])["kind"], r["start_line"], r["end_line"]) for r in found] == [("sum", 2, 4), ("max", 5, 8)]


def test_public_without_test(run):
    found = run("test.no-test-for-public-symbol", {"w.py": "def used(): pass\ndef orphan(): pass\nclass Orphan: pass\ndef _own(): pass\n", "tests/test_w.py": "used()\n", "alone.py": "def f(): pass\n"})
    assert [r["symbol"] for r in found] == ["orphan", "Orphan"]


def test_mocks_target(run):
    found = run("test.mocks-target", {"pkg/widget.py": "class Widget: pass\ndef compute(): pass\n", "tests/test_widget.py": "def test_compute(mocker):\n    mocker.patch('pkg.widget.compute')\ndef test_widget_ok():\n    patch.object(m, 'Widget')\ndef test_compute_dep():\n    patch('os.getcwd')\n"})
    assert [r["symbol"] for r in found] == ["test_compute", "test_widget_ok"]


BODY = "    a = load(1)\n    b = more(a)\n    c = mix(a, b)\n    d = last(c)\n    return d\n"


def test_dup_block(run):
    found = run("dup.block", {"a.py": "def f():\n" + BODY, "b.py": "def g():\n" + BODY, "c.py": "import a\nimport b\nimport c\nimport d\nimport e\n"})
    assert [(r["file"], r["start_line"], r["end_line"], r["severity"]) for r in found] == [("a.py", 2, 6, "warn"), ("b.py", 2, 6, "warn")]
    wide = run("dup.block", {f"m{i}.py": "def f():\n" + BODY for i in range(6)})
    assert [(r["file"], r["severity"], json.loads(r["evidence"])["total_matches"], len(json.loads(r["evidence"])["matches"])) for r in wide] == [("m0.py", "info", 6, 5)]


def test_broken_and_empty_files(run):
    assert run("risk.error-masking", {"bad.py": "def f(:\n", "empty.py": "", "__init__.py": "try:\n    x\nexcept:\n    pass\n"})[0]["file"] == "__init__.py"


def kinds(found):
    return [(r["file"], r["start_line"], json.loads(r["evidence"]).get("kind")) for r in found]


def test_masking_by_node_type(run):
    """except* is another node; a comment in the body is no no-op, one before it becomes the type; parentheses and attributes name broad errors too."""
    body = "try:\n    go()\n{}\n"
    found = run("risk.error-masking", {f"src/{i}.py": body.format(x) for i, x in enumerate(("except* ValueError:\n    pass", "except ValueError:\n    ...\n    # why\n    pass", "except:\n    # why\n    pass", "except (Exception):\n    pass", "except mod.BaseException:\n    ...", "except ValueError as Exception:\n    pass"))})
    assert kinds(found) == [("src/2.py", 3, "specific-except"), ("src/3.py", 3, "broad-except"), ("src/4.py", 3, "broad-except"), ("src/5.py", 3, "broad-except")]


def test_texts_that_are_no_python(run):
    """The text of f-strings, deep expressions, odd bytes and line ends never cost a file its findings."""
    texts = ["f\"it's {a}\"", "f'say \"hi {a}'", "f'open ( {a}'", "f'{a:{b}} {{c}} {d!r}' \"x\"", "+".join(["a"] * 3000), "'é日本' + f'é{a}'"]
    found = run("arg.mutable-default", {f"{i}.py": f"def f(a, x=[]):\n    return {t}\n" for i, t in enumerate(texts)} | {"crlf.py": "\ufeffdef f(a, x=[]):\r\n    return 1\r\n"})
    assert [r["file"] for r in found] == [f"{i}.py" for i in range(len(texts))] + ["crlf.py"]


def test_defaults_in_parentheses(run):
    assert run("arg.mutable-default", {"a.py": "def f(x=([]), y=(), z=[i for i in q]):\n    pass\n"}) == []


def test_decorators_are_outside(run):
    source = "@assert_no_logs()\ndef test_a():\n    go()\n@patch('pkg.m.compute')\ndef test_compute():\n    go()\n"
    assert [(r["symbol"], r["start_line"]) for r in run("test.assertion-free", {"test_m.py": source})] == [("test_a", 2), ("test_compute", 5)]
    assert run("test.mocks-target", {"pkg/m.py": "def compute(): pass\n", "tests/test_m.py": source}) == []


def test_methods_are_no_targets(run):
    found = run("test.mocks-target", {"pkg/m.py": "class C:\n    def compute(self): pass\ndef load(): pass\n", "tests/m.py": "def load(): pass\n", "other/m.py": "x = 1\n", "tests/test_m.py": "def test_compute():\n    patch('pkg.m.compute')\ndef test_load(m):\n    m.patch('a.load')\n    m.patch(f'b', 'x.load')\n"})
    assert [(r["symbol"], json.loads(r["evidence"])["target_file"]) for r in found] == [("test_load", "tests/m.py")]


def test_trivial_assertions(run):
    lines = ["assert (True)", "assert isinstance(f(x, 1), object)", "assert isinstance(x, (object))", "assert x != x", "assert TRUE", "assert -1", "assert 0.0", "assert 1_0.5", "assert ''", "assert f'{x}'", "assert 'a' 'b'", "assert True; assert x == x", "self.assertTrue(self.assertEqual(x, x))", "assert x == x == x", "self.assertFalse(0.0)", "self.fail(1)"]
    found = run("test.always-true-assertion", {"test_x.py": "def test_t(self, x):\n" + "".join(f"    {x}\n" for x in lines)})
    assert [(r["start_line"] - 1, json.loads(r["evidence"])["kind"]) for r in found] == [(2, "isinstance-object"), (4, "self-comparison"), (5, "constant-true"), (6, "constant-true"), (8, "constant-true"), (10, "constant-true"), (12, "self-comparison"), (13, "self-comparison"), (15, "constant-false")]


def test_parentheses_count(run):
    source = "def f(xs):\n    total = (0)\n    for x in xs:\n        total += x\n    best = xs[0]\n    for x in xs:\n        if (x > best):\n            best = x\n    t = 0\n    for x in (xs):\n        t += x\n"
    assert [json.loads(r["evidence"])["replacement"] for r in run("ponytail.reinvented", {"a.py": source})] == ["t = sum((xs))"]
    assert run("except.reraise-vs-raise", {"a.py": "try:\n    go()\nexcept E as e:\n    raise (e)\n"}) == []


def test_sleep_imports(run):
    found = run("test.time.sleep", {"test_a.py": "from time import (\n    sleep,\n)\ndef test_a():\n    sleep(1)\n", "test_b.py": "from time import time, sleep as s, sleep\ndef test_b():\n    def test_c():\n        sleep(1)\n"})
    assert sorted((r["file"], r["symbol"]) for r in found) == [("test_b.py", "test_b"), ("test_b.py", "test_c")]


def test_windows_of_strings_and_overlaps(run):
    """Windows that are mostly literals are left out; a widespread one can suppress what overlaps it; matches list the other places."""
    literal = "def f():\n" + "".join(f"    x{i} = '{'long text ' * 8}'\n" for i in range(5))
    assert run("dup.block", {"a.py": literal, "b.py": literal}) == []
    same = run("dup.block", {"a.py": "def f():\n" + BODY + "def g():\n" + BODY})
    assert [(r["start_line"], json.loads(r["evidence"])["matches"]) for r in same] == [(2, [{"file": "a.py", "span": [8, 12]}]), (8, [{"file": "a.py", "span": [2, 6]}])]
    wide = run("dup.block", {f"m{i}.py": "def f():\n" + BODY + (f"    tail = {i // 2}\n" if i < 2 else "") for i in range(7)})
    assert [(r["file"], r["severity"], json.loads(r["evidence"])["total_matches"]) for r in wide if r["severity"] == "info"] == [("m0.py", "info", 7)]


def test_file_index(spark):
    from treewarden.functions.identity import content_hash
    from treewarden.operators.analyzers import file_index
    from treewarden.operators.nodes import node_table, parse_errors

    texts = {"a.py": "def b(): pass\ndef a(): pass\nclass C:\n    def m(self):\n        def n(): pass\n", "empty.py": "", "bad.py": "def f(:\n"}
    files = spark.createDataFrame([("r", p, t, bytearray(t.encode())) for p, t in texts.items()], "repo string, path string, text string, content binary")
    table = node_table(files)
    got = {r["path"]: (r["lines"], [(s["name"], s["kind"]) for s in r["symbols"]], r["content_hash"]) for r in file_index(table, files).collect()}
    assert {p: g[:2] for p, g in got.items()} == {"a.py": (5, [("b", "function"), ("a", "function"), ("C", "class"), ("m", "method"), ("n", "method")]), "empty.py": (1, [])}
    assert got["empty.py"][2] == hashlib.blake2b(b"", digest_size=16).hexdigest() and content_hash is not None
    assert [(r["path"], r["line"]) for r in parse_errors(table).collect()] == [("bad.py", 1)]
