"""The numbers of the node table, told from the numbers of subtrees, against walks of the tree."""

from treewarden.operators.nodes import file_nodes

SOURCE = '''@a
@(b)
class C:
    # c
    @d("x" "y")
    def test_x(self, p=((1)), *, q: int = (2)):
        try:
            assert (x), f"{p!r:>{q}}"
        except (A, B) as e:  # why
            raise (e)
        return ((yield))
'''


def test_numbers():
    rows = file_nodes(SOURCE.encode())
    below: dict[int, list[int]] = {}
    for r in rows[1:]:
        below.setdefault(r["parent"], []).append(r["id"])
    assert [r["id"] for r in rows] == list(range(len(rows)))
    order, stack = [], [0]
    while stack:
        order.append(stack.pop())
        stack += below.get(order[-1], [])
    assert [rows[i]["rpre"] for i in order] == list(range(len(rows)))
    last = lambda i: max([i, *map(last, below.get(i, []))])
    assert [r["last"] for r in rows] == [last(r["id"]) for r in rows]
    assert [r["type"] for r in rows].count("parenthesized_expression") == 8
