"""The import graph of a tree's modules: its edges, what is on a cycle, layers, and imports against a given order of layers.

Edges come from the node table. An import depends on the longest part of its name that is a module of the same tree, so ``from a import b`` is an edge to
a.b where that is one and to a otherwise; a name without such a part is an edge to nothing. Packages that Python runs on the way (a for a.b) are no edges of their own.

A tree of at most ``most`` edges is one task's work, in one pass. Larger ones are worked on as tables of edges, all at once, so that no task holds such a graph:
each round is one join and writes what is left; rounds follow the length of paths, not the number of modules. Results are the same.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import merging, written
from .analyzers import FILE, Analyzer

#: Edges of a tree that one task may hold.
MOST_EDGES = 200_000

CYCLE = Analyzer("arch.cycle", "1", True, lambda nodes, files: CYCLE.finish(cycle_imports(import_edges(nodes))))


def module_name(path: Column, roots: tuple[str, ...] = ("src",)) -> Column:
    """The name by which a file is imported: the path below the first of ``roots`` that it begins with, dotted, a package by its folder."""
    below = reduce(lambda out, root: F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 20)).otherwise(out), reversed(roots), path)
    return F.regexp_replace(F.replace(F.regexp_replace(below, r"(^|/)__init__\.py$|\.py$", ""), F.lit("/"), F.lit(".")), r"^\.", "")


def imported_names(nodes: DataFrame, roots: tuple[str, ...] = ("src",)) -> DataFrame:
    """(repo, path, name, line): full names that a file imports, relative ones resolved by its package, with the first line of each. Relative imports that leave the tree drop out."""
    aliases = nodes.where("type = 'alias' AND role = 'names'").select(*FILE, "parent", "text")
    statements = nodes.where("type IN ('import', 'importfrom')").select(*FILE, F.col("id").alias("parent"), "type", F.col("text").alias("base"), F.col("start").alias("line"))
    found = aliases.join(merging(statements), [*FILE, "parent"])
    module = F.split(module_name(F.col("path"), roots), r"\.")
    level = F.length(F.regexp_extract("base", r"^\.*", 0))
    # a package is its own package, a module's is the folder
    kept = F.size(module) - level + F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), 1).otherwise(0)
    stem = F.filter(F.split(F.regexp_replace("base", r"^\.+", ""), r"\."), lambda x: x != "")
    package = F.when(level == 0, F.array().cast("array<string>")).when(kept >= 1, F.slice(module, 1, kept))
    tail = F.when(F.col("text") == "*", F.array().cast("array<string>")).otherwise(F.array("text"))
    name = F.when(F.col("type") == "import", F.col("text")).otherwise(F.array_join(F.concat(package, stem, tail), "."))
    return found.select(*FILE, name.alias("name"), "line").where("name IS NOT NULL AND name != ''").groupBy(*FILE, "name").agg(F.min("line").alias("line"))


def import_edges(nodes: DataFrame, roots: tuple[str, ...] = ("src",)) -> DataFrame:
    """(repo, path, target, line): a file and another of its tree that it imports, by the first line that does. Of a module and a package of one name the package is meant, of two of a kind the one with the smaller path. A file that imports itself has no edge."""
    path = F.col("path")
    modules = nodes.where("id = 0").select("repo", path, module_name(path, roots).alias("module")).where("module != ''")
    modules = modules.groupBy("repo", "module").agg(F.min_by("path", F.struct(~path.endswith("__init__.py"), path)).alias("target"))
    part = F.split("name", r"\.")
    prefix = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, F.lit(1), i), "."))
    asked = imported_names(nodes, roots).select("*", F.explode(prefix).alias("module"))
    best = asked.join(merging(modules), ["repo", "module"]).groupBy(*FILE, "name").agg(F.max_by("target", F.length("module")).alias("target"), F.min("line").alias("line"))
    return best.where("path != target").groupBy(*FILE, "target").agg(F.min("line").alias("line"))


def _core(edges: DataFrame) -> DataFrame:
    """The edges left when those from where no edge leads to, and to where no edge leads on, go again and again."""
    n = edges.count()
    while n:
        entered, left = edges.select("repo", F.col("target").alias("path")).distinct(), edges.select("repo", F.col("path").alias("target")).distinct()
        edges = written(edges.join(merging(entered), FILE, "left_semi").join(merging(left), ["repo", "target"], "left_semi").select(*FILE, "target"), "core")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(repo, path, colour): the smallest path from where edges lead to a file, its own included."""
    ends = edges.select(*FILE).union(edges.select("repo", "target")).distinct()
    colours = written(ends.withColumn("colour", F.col("path")), "colours")
    while True:
        passed = edges.join(merging(colours.select(*FILE, "colour")), FILE).select("repo", F.col("target").alias("path"), "colour", F.lit(None).cast("string").alias("was"))
        both = colours.select(*FILE, "colour", F.col("colour").alias("was")).unionByName(passed)
        colours = written(both.groupBy(*FILE).agg(F.min("colour").alias("colour"), F.max("was").alias("was")), "colours")
        if not colours.where("colour != was").head(1):
            return colours.drop("was")


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tree's files with component and layer, for every end of an edge. Depth first, with a stack instead of recursion: a component closes when its first file has nothing more below, after all that it leads to."""
    out: dict[str, list[str]] = {x: [] for x in [*pdf["path"], *pdf["target"]]}
    for a, b in zip(pdf["path"], pdf["target"], strict=True):
        out[a].append(b)
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    done: dict[str, tuple[str, int]] = {}
    waiting: list[str] = []
    for root in out:
        todo = [] if root in seen else [(root, iter(out[root]))]
        while todo:
            at, below = todo[-1]
            if at not in seen:
                seen[at] = low[at] = len(seen)
                waiting.append(at)
            deeper = None
            for x in below:
                if x not in seen:
                    deeper = x
                    break
                if x not in done:  # on the way here
                    low[at] = min(low[at], seen[x])
            if deeper is not None:
                todo.append((deeper, iter(out[deeper])))
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[at])
            if low[at] == seen[at]:
                own = set()
                while at not in own:
                    own.add(waiting.pop())
                members = sorted(own)
                layer = max((done[b][1] + 1 for a in members for b in out[a] if b not in own), default=0)
                done |= dict.fromkeys(members, (members[0], layer))
    return pd.DataFrame({"repo": pdf["repo"].iloc[0], "path": list(done), "component": [c for c, _ in done.values()], "layer": [n for _, n in done.values()]})


def _by_size(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(repo, path, component, layer) of trees of at most ``most`` edges, a task a tree, and the edges of the others."""
    sizes = written(edges.groupBy("repo").agg((F.count("*") > most).alias("large")), "sizes")
    small = edges.join(sizes.where("NOT large"), "repo", "left_semi").groupBy("repo").applyInPandas(_settled, "repo string, path string, component string, layer int")
    return written(small, "small"), edges.join(sizes.where("large"), "repo", "left_semi")


def components(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(repo, path, component): the files that lie on cycles, with the smallest path of all that they reach and that reach them."""
    small, large = _by_size(written(edges.select(*FILE, "target").where("path != target").distinct(), "edges"), most)
    several = small.groupBy("repo", "component").agg(F.count("*").alias("n")).where("n > 1")
    return small.join(merging(several), ["repo", "component"], "left_semi").select(*FILE, "component").unionByName(_components_in_rounds(large))


def _components_in_rounds(edges: DataFrame) -> DataFrame:
    """Components of trees of any size.

    Each file takes the colour of the smallest path that reaches it; one whose colour is its own path is the first of its component, whose other members are
    those of the colour that reach it. Edges between colours, and of what is settled, can't be on another cycle; the rest goes round again.
    """
    left = edges
    settled = edges.sparkSession.createDataFrame([], "repo string, path string, component string")
    while True:
        left = _core(left)
        if not left.head(1):
            return settled
        colours = _colours(left)
        to = colours.select("repo", F.col("path").alias("target"), F.col("colour").alias("to"))
        within = written(left.join(merging(colours), FILE).join(merging(to), ["repo", "target"]).where("colour = to").drop("to"), "within")
        reached = frontier = written(colours.where("path = colour").select(*FILE, F.col("colour").alias("component")), "reached")
        while frontier.head(1):
            on = frontier.select("repo", F.col("path").alias("target"))
            frontier = written(within.join(merging(on), ["repo", "target"], "left_semi").select(*FILE, F.col("colour").alias("component")).distinct().join(merging(reached.select(*FILE)), FILE, "left_anti"), "reached")
            reached = reached.unionByName(frontier)
        ends = within.select(*FILE, F.col("colour").alias("component")).union(within.select("repo", "target", "colour")).distinct()
        # the first of a component stands on a cycle only if another one reaches it
        several = reached.groupBy("repo", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        settled = settled.unionByName(written(reached.join(merging(ends), [*FILE, "component"], "left_semi").join(merging(several), ["repo", "component"], "left_semi").select(*FILE, "component"), "settled"))
        gone = written(reached.select(*FILE), "gone")
        left = written(within.join(merging(gone), FILE, "left_anti").join(merging(gone.withColumnRenamed("path", "target")), ["repo", "target"], "left_anti").select(*FILE, "target"), "edges")


def layers(files: DataFrame, edges: DataFrame, found: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(repo, path, layer) of all ``files``: 0 where nothing of the tree is imported, else one above the highest layer imported. Files of one component (``found``) share theirs.

    In rounds, each keeps the edges to what still has edges of its own; the last round in which a file has one is its layer.
    """
    of = found.select(*FILE, "component")
    end = of.select("repo", F.col("path").alias("target"), F.col("component").alias("to"))
    between = edges.join(merging(of), FILE, "left").join(merging(end), ["repo", "target"], "left").select("repo", F.coalesce("component", "path").alias("path"), F.coalesce("to", "target").alias("target")).where("path != target").distinct()
    small, large = _by_size(written(between, "layer"), most)
    left, rounds = large, [small.select(*FILE, "layer")]
    while left.head(1):
        rounds.append(left.select(*FILE, F.lit(len(rounds)).alias("layer")))
        above = left.select("repo", F.col("path").alias("target")).distinct()
        left = written(left.join(merging(above), ["repo", "target"], "left_semi").select(*FILE, "target"), "layer")
    all_files = files.select(*FILE).distinct().join(merging(of), FILE, "left").select(*FILE, F.coalesce("component", "path").alias("component"))
    high = reduce(DataFrame.unionByName, rounds).groupBy("repo", F.col("path").alias("component")).agg(F.max("layer").alias("layer"))
    return all_files.join(merging(high), ["repo", "component"], "left").select(*FILE, F.coalesce("layer", F.lit(0)).alias("layer"))


def cycle_imports(edges: DataFrame) -> DataFrame:
    """Each import between two files of one component, as rows of ``Analyzer.finish``: arch.cycle."""
    edges = written(edges, "edges")
    found = components(edges)
    sizes = found.groupBy("repo", "component").agg(F.count("*").alias("size"))
    end = found.select("repo", F.col("path").alias("target"), F.col("component").alias("to"))
    inside = edges.join(merging(found), FILE).join(merging(end), ["repo", "target"]).where("component = to").join(merging(sizes), ["repo", "component"])
    message = F.concat(F.lit("import of `"), F.col("target"), F.lit("` is part of a cycle among "), F.col("size").cast("string"), F.lit(" modules"))
    return inside.select(*FILE, F.col("line").alias("start"), F.col("line").alias("end"), F.lit(None).alias("symbol"), F.lit("warn").alias("severity"), message.alias("message"), F.struct("target", "component", "size").alias("evidence"))


def layer_imports(edges: DataFrame, order: list[tuple[str, list[str]]]) -> DataFrame:
    """Imports upwards, as rows of ``Analyzer.finish``: arch.layer. ``order`` names layers from the lowest on, each with its folders; the longest folder that a path begins with tells its layer, and files of none are free."""
    folders = sorted(((folder.rstrip("/") + "/", rank) for rank, (_, of) in enumerate(order) for folder in of), key=lambda f: len(f[0]))
    names = F.array(*[F.lit(name) for name, _ in order])

    def rank(path: str) -> Column:
        return reduce(lambda out, f: F.when(F.col(path).startswith(f[0]), f[1]).otherwise(out), folders, F.lit(None).cast("int"))

    up = edges.withColumn("a", rank("path")).withColumn("b", rank("target")).where("a < b").withColumn("layer", F.get(names, F.col("a"))).withColumn("above", F.get(names, F.col("b")))
    message = F.concat(F.lit("`"), F.col("layer"), F.lit("` imports `"), F.col("target"), F.lit("` of `"), F.col("above"), F.lit("` above it"))
    return up.select(*FILE, F.col("line").alias("start"), F.col("line").alias("end"), F.lit(None).alias("symbol"), F.lit("warn").alias("severity"), message.alias("message"), F.struct("target", "layer", "above").alias("evidence"))


def layered(order: list[tuple[str, list[str]]]) -> Analyzer:
    """The analyzer arch.layer for one order of layers; it and ``CYCLE`` join the others only where a caller puts them into the registry."""
    out = Analyzer("arch.layer", "1", True, lambda nodes, files: out.finish(layer_imports(import_edges(nodes), order)))
    return out
