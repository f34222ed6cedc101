"""Queries of the import graph, over modules made of the part table.

Keys come in blocks of five, three blocks to a group. Every module imports the next key of its group; blocks whose number 3 divides are rings, those after have
a cycle of their middle three, and the third key of the others imports itself. Modules of even keys are in core, others in app.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.architecture import CYCLE, components, import_edges, layered, layers
from ..operators.nodes import node_table
from ..functions.scratch import written
from .source import PLAIN

LAYERED = layered([("core", ["src/pkg/core"]), ("app", ["src/pkg/app"])])


def module_files(spark, sf_dir):
    """repo, path, text, content: what a key imports is told by it alone, in one of four ways."""
    k = F.col("k")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
    i, b = k % 5, F.floor(k / 5) % 3
    folder = lambda key: F.when(key % 2 == 0, "core").otherwise("app")
    name = lambda key: F.concat(F.lit("m_"), key.cast("string"))

    def line(key):
        at, what = folder(key), name(key)
        return F.when(k % 4 == 0, F.concat(F.lit("from pkg."), at, F.lit(" import "), what)).when(k % 4 == 1, F.concat(F.lit("import pkg."), at, F.lit("."), what, F.lit(" as m"))).when(k % 4 == 2, F.concat(F.lit("from .."), at, F.lit(" import (\n    "), what, F.lit(",\n)"))).otherwise(F.concat(F.lit("from .."), at, F.lit("."), what, F.lit(" import f")))

    then = [F.when((i < 4) | (b != 2), line(k + 1)), F.when((b == 0) & (i == 4), line(k - 4)), F.when((b == 1) & (i == 3), line(k - 2)), F.when((b == 2) & (i == 2), line(k))]
    text = F.concat(F.lit("import os\n"), F.array_join(F.array_compact(F.array(*then)), "\n"), F.lit("\n\ndef f():\n    return os.name\n"))
    return part.select(F.lit("r").alias("repo"), F.concat(F.lit("src/pkg/"), folder(k), F.lit("/"), name(k), F.lit(".py")).alias("path"), text.alias("text"), text.cast("binary").alias("content"))


def _edges(spark, sf_dir):
    nodes = node_table(module_files(spark, sf_dir))
    return nodes, written(import_edges(nodes), "edges")


def import_graph(spark, sf_dir):
    return _edges(spark, sf_dir)[1].select("path", "target", "line")


def import_cycles(spark, sf_dir):
    return components(_edges(spark, sf_dir)[1]).select("path", "component")


def import_layers(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return layers(nodes.where("id = 0"), edges, components(edges)).select("path", "layer")


def arch_cycle(spark, sf_dir):
    source = module_files(spark, sf_dir)
    return CYCLE.run(node_table(source), source).select(*PLAIN)


def arch_layer(spark, sf_dir):
    source = module_files(spark, sf_dir)
    return LAYERED.run(node_table(source), source).select(*PLAIN)


QUERIES = {"import_graph": import_graph, "import_cycles": import_cycles, "import_layers": import_layers, "arch_cycle": arch_cycle, "arch_layer": arch_layer}

_GRAPH = """WITH RECURSIVE m AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_partkey % 5 AS i, (p_partkey // 5) % 3 AS b, 'src/pkg/' || CASE WHEN p_partkey % 2 = 0 THEN 'core' ELSE 'app' END || '/m_' || p_partkey || '.py' AS path FROM part),
x AS (SELECT k, path, k + 1 AS t, 2 AS line FROM m WHERE i < 4 OR b <> 2
 UNION ALL SELECT k, path, k - 4, CASE WHEN k % 4 = 2 THEN 5 ELSE 3 END FROM m WHERE b = 0 AND i = 4
 UNION ALL SELECT k, path, k - 2, CASE WHEN k % 4 = 2 THEN 5 ELSE 3 END FROM m WHERE b = 1 AND i = 3),
e AS (SELECT x.k AS s, x.t, x.path, m.path AS target, CAST(x.line AS INTEGER) AS line FROM x JOIN m ON m.k = x.t),
reach(a, z) AS (SELECT s, t FROM e UNION SELECT reach.a, e.t FROM reach JOIN e ON reach.z = e.s),
c AS (SELECT m.k, m.path, min(o.path) AS component FROM reach r JOIN reach q ON q.a = r.z AND q.z = r.a JOIN m ON m.k = r.a JOIN m o ON o.k = r.z GROUP BY m.k, m.path)"""
_FOUND = "analyzer_id, 'warn' AS severity, path AS file, line AS start_line, line AS end_line, CAST(NULL AS VARCHAR) AS symbol"

ORACLES = {
    "import_graph": _GRAPH + " SELECT path, target, line FROM e",
    "import_cycles": _GRAPH + " SELECT path, component FROM c",
    "import_layers": _GRAPH + """, g AS (SELECT m.path, coalesce(c.component, m.path) AS component FROM m LEFT JOIN c ON c.k = m.k),
d AS (SELECT DISTINCT f.component AS s, h.component AS t FROM e JOIN g f ON f.path = e.path JOIN g h ON h.path = e.target WHERE f.component <> h.component),
l(v, n) AS (SELECT component, 0 FROM g UNION SELECT d.s, l.n + 1 FROM l JOIN d ON d.t = l.v), h AS (SELECT v, max(n) AS layer FROM l GROUP BY v)
SELECT g.path, CAST(h.layer AS INTEGER) AS layer FROM g JOIN h ON h.v = g.component""",
    "arch_cycle": _GRAPH + f", z AS (SELECT component, count(*) AS size FROM c GROUP BY component) SELECT 'arch.cycle' AS {_FOUND}, 'import of `' || target || '` is part of a cycle among ' || size || ' modules' AS message FROM e JOIN c ON c.k = e.s JOIN c o ON o.k = e.t AND o.component = c.component JOIN z ON z.component = c.component".replace("path AS file", "e.path AS file"),
    "arch_layer": _GRAPH + f" SELECT 'arch.layer' AS {_FOUND}, '`core` imports `' || target || '` of `app` above it' AS message FROM e WHERE s % 2 = 0 AND t % 2 = 1",
}
