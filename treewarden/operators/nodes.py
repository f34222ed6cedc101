"""The node table: one parse of each file into rows, over which all analyzers are relational.

Numbers are preorder; a node's descendants are those with id in (id, last]. rpre is the rank in the order that takes a node
before its children and its children from right to left. Comments are nodes of the block whose lines hold them, redundant
parentheses are nodes around what they enclose, and a definition's decorators stand beside it below a node of their own, so they are no part of it.
A function row knows whether a class is above it (method). Calls, assertions and raises know the test functions and except clauses around them (owners), outermost first. Files that don't parse have one row of type parse_error.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.scratch import spread, written

#: Names of node types.
TYPES = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "ExceptHandler": "except_clause", "Pass": "pass_statement",
    "Assert": "assert_statement", "Call": "call", "Raise": "raise_statement", "For": "for_statement", "AsyncFor": "for_statement", "Name": "identifier", "Attribute": "attribute",
    "Assign": "assignment", "AugAssign": "augmented_assignment", "Compare": "comparison_operator", "List": "list", "Dict": "dictionary", "Set": "set", "If": "if_statement",
    "JoinedStr": "string", "Tuple": "tuple", "Expr": "expression_statement",
    "Try": "try_statement", "TryStar": "try_statement",
}
SCHEMA = "repo string, path string, id int, parent int, last int, rpre int, ordinal int, type string, role string, children int, method boolean, start int, end int, start_byte long, end_byte long, text string, source string, lines array<string>, offsets array<long>, owners array<int>"
SOURCED = {"call", "except_clause", "raise_statement", "assert_statement", "string", "integer", "float", "true", "false", "identifier", "attribute", "list", "dictionary", "set", "comparison_operator", "subscript", "unaryop", "parenthesized_expression", "concatenated_string"}
#: What analyzers look for in subtrees of owners.
OWNED = {"call", "assert_statement", "raise_statement"}
#: Parts of the tree that stand for no text of their own.
_SILENT = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
_LAYOUT = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class _ByClass(dict):
    """What is told by a node's class alone, worked out once a class."""

    def __init__(self, tell):
        super().__init__()
        self.tell = tell

    def __missing__(self, of: type):
        self[of] = told = self.tell(of)
        return told


_TYPE = _ByClass(lambda of: TYPES.get(of.__name__, of.__name__.lower()))
_LOUD = _ByClass(lambda of: issubclass(of, ast.AST) and not issubclass(of, _SILENT))
_FIELDS = _ByClass(lambda of: tuple(f for f in of._fields if f != "decorator_list"))
_EXPRESSION = _ByClass(lambda of: issubclass(of, ast.expr))


def normalized_bytes(content: bytes) -> bytes:
    return content.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n")


class _Tokens:
    """What the tree doesn't tell: comments, redundant parentheses, and the single literals of a string."""

    def __init__(self, src: bytes, starts: list[int]):
        self.comments: list[tuple[int, int, str]] = []  # line, first byte, text
        self.literals: list[tuple[int, int, int]] = []  # first byte, end, depth of f-strings around
        self.first: dict[int, int] = {}  # byte to the token that begins there
        self.last: dict[int, int] = {}  # byte to the token that ends there
        self.pairs: dict[int, int] = {}  # token of a grouping parenthesis to that of its end
        self.begins: list[int] = []
        opened, formats, n = [], [], 0
        before, said = None, ""  # type and string of the token before
        plain = src.isascii()
        for kind, string, (row, column), _, text in tokenize.generate_tokens(io.StringIO(src.decode("utf-8", "replace")).readline):
            if kind in _LAYOUT:
                continue
            line = starts[row - 1]
            begin = line + (column if plain or text.isascii() else len(src[line : starts[row]].decode("utf-8", "replace")[:column].encode()))
            if kind == tokenize.COMMENT:
                self.comments.append((row, begin, string))
                continue
            end = begin + (len(string) if plain else len(string.encode()))
            self.first[begin], self.last[end] = n, n
            self.begins.append(begin)
            if kind == tokenize.OP:
                if string in "([{":
                    called = before is not None and (before in (tokenize.STRING, tokenize.NUMBER, tokenize.FSTRING_END) or said in (")", "]", "}") or before == tokenize.NAME and (not keyword.iskeyword(said) or said in ("None", "True", "False")))
                    opened.append((n, string == "(" and not called))
                elif string in ")]}" and opened:
                    at, groups = opened.pop()
                    if groups:
                        self.pairs[at] = n
            elif kind == tokenize.STRING:
                self.literals.append((begin, end, len(formats)))
            elif kind == tokenize.FSTRING_START:
                formats.append(begin)
            elif kind == tokenize.FSTRING_END:
                self.literals.append((formats.pop(), end, len(formats)))
            before, said, n = kind, string, n + 1
        self.literals.sort()

    def around(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Spans of the parentheses directly around an expression, outermost first."""
        if not self.pairs:
            return []
        i, j, out = self.first.get(begin), self.last.get(end), []
        while i is not None and j is not None and i > 0 and self.pairs.get(i - 1) == j + 1:
            i, j = i - 1, j + 1
            out.append((self.begins[i], self.begins[j] + 1))
        return out[::-1]

    def pieces(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Spans of the literals that make up a string."""
        i = bisect.bisect_left(self.literals, (begin, 0, 0))
        found = self.literals[i : bisect.bisect_left(self.literals, (end, 0, 0))]
        return [x[:2] for x in found if x[2] == found[0][2]]


class _File:
    """Rows of one parsed file."""

    def __init__(self, content: bytes):
        self.src = normalized_bytes(content)
        tree = ast.parse(self.src)
        self.starts = [0]
        for line in self.src.split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.tokens = _Tokens(self.src, self.starts)
        self.rows: list[dict] = []
        self.of_block = self._comments(tree)
        self._visit(tree)
        self._reverse()

    def _bytes(self, node) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def _line(self, byte: int) -> int:
        return bisect.bisect_right(self.starts, byte)

    def _comments(self, tree) -> dict[int, list]:
        """Comments by the innermost block that holds them, with the role of the list of statements that they stand in."""
        if not self.tokens.comments:
            return {}
        blocks = [(1, len(self.starts), tree)]
        blocks += sorted(((n.lineno, n.end_lineno, n) for n in ast.walk(tree) if isinstance(getattr(n, "body", None), list) and hasattr(n, "lineno")), key=lambda b: (b[0], -b[1]))
        out: dict[int, list] = {}
        stack, at = [], 0
        for line, byte, text in self.tokens.comments:
            while at < len(blocks) and blocks[at][0] <= line:
                stack.append(blocks[at])
                at += 1
            while stack[-1][1] < line and len(stack) > 1:
                stack.pop()
            block = next(b for b in reversed(stack) if b[1] >= line)[2]
            lists = [(x[0].lineno, role) for role in ("body", "handlers", "orelse", "finalbody") if (x := getattr(block, role, None))]
            role = max((r for r in lists if r[0] <= line), default=(0, "body" if isinstance(block, ast.Module) else "type"))[1]
            out.setdefault(id(block), []).append((role, ("comment", line, byte, text)))
        return out

    def _children(self, node) -> list[tuple[str, object]]:
        out = []
        for role in _FIELDS[type(node)]:
            value = getattr(node, role, None)
            if type(value) is list:
                out += [(role, x) for x in value if _LOUD[type(x)]]
            elif _LOUD[type(value)]:
                out.append((role, value))
        if type(node) is ast.arguments:
            plain = [*node.posonlyargs, *node.args]
            pairs = [*zip(plain[len(plain) - len(node.defaults) :], node.defaults, strict=True), *((a, d) for a, d in zip(node.kwonlyargs, node.kw_defaults, strict=True) if d is not None)]
            out = [("parameter", ("default", *p)) for p in pairs]
        if self.of_block:
            out += self.of_block.get(id(node), [])
        if len(out) > 1:
            out.sort(key=lambda x: self._at(x[1]))
        return out

    def _at(self, x) -> tuple[int, int]:
        if isinstance(x, tuple):
            return (x[1], x[2] - self.starts[x[1] - 1]) if x[0] == "comment" else self._at(x[1])
        if isinstance(x, ast.arguments):
            return min((self._at(a) for a in [*x.posonlyargs, *x.args, *x.kwonlyargs]), default=(0, 0))
        if decorators := getattr(x, "decorator_list", None):
            return self._at(decorators[0])
        return (x.lineno, x.col_offset) if hasattr(x, "lineno") else (0, 0)

    def _visit(self, tree) -> None:
        """Rows in preorder, from a stack of what is still to come. A number on it closes that row's subtree."""
        stack: list = [(tree, None, "module", 0, False)]
        owners: list[int] = []
        rows = self.rows
        while stack:
            entry = stack.pop()
            if type(entry) is int:
                rows[entry]["last"] = len(rows) - 1
                if owners and owners[-1] == entry:
                    owners.pop()
                continue
            node, parent, role, ordinal, within = entry
            kind, children, at = type(node), [], len(rows)
            if kind is tuple:
                if node[0] == "comment":
                    row = {"type": "comment", "text": node[3], "start": node[1], "end": node[1], "start_byte": node[2]}
                else:  # a parameter with its default
                    _, arg, value = node
                    row = {"type": "default_parameter" if arg.annotation is None else "typed_default_parameter", "text": arg.arg, "start": arg.lineno, "end": value.end_lineno}
                    children = [("value", value)]
            elif kind is _Bare:
                node, row = node.node, node.row
                kind = type(node)
            else:
                outer = parent
                if _EXPRESSION[kind]:
                    inner = False
                    for begin, end in self.tokens.around(*self._bytes(node)):
                        rows.append({"type": "parenthesized_expression", "source": self._text(begin, end), "start": self._line(begin), "end": self._line(end - 1), "start_byte": begin, "end_byte": end, "id": len(rows), "parent": parent, "role": role, "ordinal": ordinal, "children": 1})
                        parent, inner = len(rows) - 1, True
                    if inner:
                        role, ordinal = "inner", 0
                row = self._row(node, role == "format_spec" or outer is not None and rows[outer]["type"] in ("string", "concatenated_string", "string_content"))
                if kind in _DEFINITIONS and node.decorator_list:
                    decorators = node.decorator_list
                    rows.append({"type": "decorated_definition", "start": decorators[0].lineno, "end": node.end_lineno, "id": at, "parent": parent, "role": role, "ordinal": ordinal, "children": len(decorators) + 1})
                    # decorators first, then the definition without them
                    stack += [at, (_Bare(node, row), at, "definition", len(decorators), within)]
                    stack += [(d, at, "decorator", i, within) for i, d in reversed(list(enumerate(decorators)))]
                    continue
            me = len(rows)
            if kind is not tuple:
                children = self._children(node)
                if row["type"] == "function_definition":
                    row["method"] = within
                    if node.name.startswith("test_"):
                        owners.append(me)
                elif row["type"] in OWNED:
                    row["owners"] = list(owners)
                elif row["type"] == "except_clause":
                    owners.append(me)
            row["id"], row["parent"], row["role"], row["ordinal"], row["children"] = me, parent, role, ordinal, len(children)
            rows.append(row)
            if kind is ast.ExceptHandler and node.name:
                rows.append({"type": "identifier", "text": node.name, "start": node.lineno, "end": node.lineno, "id": me + 1, "parent": me, "role": "alias", "ordinal": -1, "children": 0, "last": me + 1})
            elif row["type"] == "concatenated_string":
                for i, (begin, end) in enumerate(self.tokens.pieces(row["start_byte"], row["end_byte"])):
                    piece = len(rows)
                    rows.append({"type": "string", "source": self._text(begin, end), "text": self._text(begin, end), "start": self._line(begin), "end": self._line(end - 1), "start_byte": begin, "end_byte": end, "id": piece, "parent": me, "role": "piece", "ordinal": i, "children": 0, "last": piece})
            if not children and at == me and not (owners and owners[-1] == me):
                row["last"] = len(rows) - 1
                continue
            within = within or kind is ast.ClassDef
            stack += range(at, me + 1)
            for i in range(len(children) - 1, -1, -1):
                stack.append((children[i][1], me, children[i][0], i, within))

    def _text(self, begin: int, end: int) -> str:
        return self.src[begin:end].decode("utf-8", "replace")

    def _string(self, begin: int, end: int) -> str:
        return "string" if len(self.tokens.pieces(begin, end)) < 2 else "concatenated_string"

    def _row(self, node, in_string: bool) -> dict:
        """``in_string``: the node is a piece of an f-string's text and no literal of its own."""
        of = type(node)
        kind, text = _TYPE[of], None
        if not hasattr(node, "lineno"):
            return {"type": kind, "start": 1, "end": len(self.starts) - 1}
        begin, end = self._bytes(node)
        if of is ast.JoinedStr:
            kind = "string_content" if in_string else self._string(begin, end)
        elif of is ast.Constant:
            if isinstance(node.value, (str, bytes)):
                kind = "string_content" if in_string else self._string(begin, end)
            elif node.value is Ellipsis:
                kind = "ellipsis"
            else:
                kind = {True: "true", False: "false"}[node.value] if isinstance(node.value, bool) else {int: "integer", float: "float"}.get(type(node.value), "none")
        elif of is ast.ExceptHandler and self.src[begin + 6 : end].lstrip(b" \t\f\\\n").startswith(b"*"):
            kind = "except_group_clause"
        source = self._text(begin, end) if kind in SOURCED else None
        if of in _DEFINITIONS:
            text = node.name
        elif of is ast.Call:
            text = self._text(*(self.tokens.around(*self._bytes(node.func)) or [self._bytes(node.func)])[0])
        elif of is ast.AugAssign:
            text = type(node.op).__name__
        elif of is ast.alias:
            text = node.name
        elif of is ast.ImportFrom:
            text = "." * node.level + (node.module or "")
        elif of is ast.Compare:
            text = type(node.ops[0]).__name__ if len(node.ops) == 1 else "chain"
        else:
            text = source
        row = {"type": kind, "text": text, "source": source, "start": node.lineno, "end": node.end_lineno, "start_byte": begin, "end_byte": end}
        if kind == "function_definition":
            head = node.body[0]
            block, first = self._bytes(head)[0], head.lineno
            if decorators := getattr(head, "decorator_list", None):
                first = decorators[0].lineno
                block = self.src.rindex(b"@", 0, self._bytes(decorators[0])[0])
            row["lines"] = [x.decode("utf-8", "replace").rstrip() for x in self.src[block:end].split(b"\n")]
            row["offsets"] = [first, *self.starts[first - 1 : first + len(row["lines"])]]
        return row

    def _reverse(self) -> None:
        """A node's siblings to the right, whole, come between its parent and it: the numbers after its last one up to the parent's."""
        self.rows[0]["rpre"] = 0
        for r in self.rows[1:]:
            above = self.rows[r["parent"]]
            r["rpre"] = above["rpre"] + 1 + above["last"] - r["last"]


class _Bare:
    """A definition whose decorators have been taken off."""

    def __init__(self, node, row: dict):
        self.node, self.row = node, row


def file_nodes(content: bytes) -> list[dict]:
    """Rows of one file; of a file that doesn't parse, one row of type parse_error."""
    try:
        return _File(content).rows
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as e:
        return [{"id": 0, "last": 0, "rpre": 0, "ordinal": 0, "children": 0, "type": "parse_error", "role": "module", "start": getattr(e, "lineno", None) or 1, "end": getattr(e, "lineno", None) or 1, "text": str(e)[:200]}]


def nodes(files: DataFrame) -> DataFrame:
    """The node table of files (repo, path, content binary). Rows of deleted files should be filtered out before.

    Lazy: every branch of a plan parses again. ``node_table`` parses once. Few large partitions are dealt out over all cores first.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.int32(), pa.bool_(), *[pa.int32()] * 2, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict], of: list[tuple[str, str, int]]) -> pa.RecordBatch:
            keys = [[x for f in of for x in [f[i]] * f[2]] for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*keys, *([r.get(n) for r in rows] for n in names[2:])], types, strict=True)], names)

        for b in batches:
            rows: list[dict] = []
            of: list[tuple[str, str, int]] = []  # each file, and how many rows it has
            for repo, path, content in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "content")), strict=True):
                found = file_nodes(content or b"")
                rows += found
                of.append((repo, path, len(found)))
                if len(rows) > 20_000:
                    yield batch(rows, of)
                    rows, of = [], []
            yield batch(rows, of)

    return spread(files.select("repo", "path", files["content"].cast("binary").alias("content"))).mapInArrow(run, SCHEMA)


def node_table(files: DataFrame) -> DataFrame:
    """The node table, parsed once and written to the shared folder: analyzers read only the columns and types that they need."""
    return written(nodes(files), "nodes")


def parse_errors(nodes: DataFrame) -> DataFrame:
    """(repo, path, line, message) of the files that didn't parse."""
    return nodes.where("type = 'parse_error'").select("repo", "path", nodes["start"].alias("line"), nodes["text"].alias("message"))
