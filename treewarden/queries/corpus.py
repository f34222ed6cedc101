"""A source corpus made of the part table: paths and texts are string functions of p_partkey and p_size.

Spark parses the texts; the SQL beside each query tells the findings from the parameters alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nodes import node_table

#: Template number (p_partkey modulo their count) to text; {k} is the key.
TEMPLATES = [
    "def f{k}():\n    try:\n        go()\n    except:\n        pass\n",
    "def f{k}():\n    try:\n        go()\n    except (Exception, OSError) as e:\n        ...\n",
    "def f{k}():\n    try:\n        go()\n    except ValueError:\n        pass\n",
    "def f{k}():\n    try:\n        go()\n    except Exception:\n        log()\n",
    "def f{k}(a, b=[], c=None):\n    return b\n",
    "def f{k}(a, *, b=dict()):\n    return b\n",
    "def f{k}(a, b: list = [], c=(1, 2)):\n    return b\n",
    "def f{k}(x):\n    try:\n        go()\n    except ValueError as e:\n        if x: raise e\n",
    "def f{k}():\n    try:\n        go()\n    except ValueError as e:\n        raise\n",
    "class C{k}:\n    def m(self, xs):\n        total = 0\n        for x in xs:\n            total += x\n        return total\n",
    "def f{k}(xs):\n    best = xs[0]\n    for x in xs:\n        if x > best:\n            best = x\n",
    "def f{k}(xs):\n    total = 1\n    for x in xs:\n        total += x\n    return total\n",
    # text in f-strings that is no Python by itself
    "def f{k}(a, b=[]):\n    return f\"it's {a} {'n'} ( \"\n",
    "def f{k}():\n    try:\n        go()\n    except* ValueError:\n        pass\n",
    "def f{k}():\n    try:\n        go({k})\n    except ValueError:\n        ...\n        # why\n        pass\n",
    "def f{k}(a, b=([])):\n    return b\n",
    "def f{k}():\n    try:\n        go()\n    except ValueError as e:\n        raise (e)\n",
    # the last of two in a handler, and one below a nested function
    "def f{k}(x):\n    try:\n        go({k})\n    except ValueError as e:\n        if x: raise e\n        raise e\n",
    "def test_a{k}():\n    go()\n",
    "def test_a{k}():\n    assert True\n    assert go() == 3\n",
    "import time\ndef test_a{k}():\n    time.sleep({k})\n    assert go()\n",
    "def test_a{k}(x):\n    assert x == x\n    self.assertEqual(go(), x)\n",
    # decorators are no part of the function
    "@assert_no_logs()\ndef test_a{k}():\n    go()\n",
    # the right one of two on a line
    "def test_a{k}(x):\n    assert True; assert x == x\n    go()\n",
    "def test_a{k}():\n    assert (True)\n",
    "def test_a{k}(x):\n    assert isinstance(go(x, 1), object)\n",
    "def test_a{k}(x):\n    assert f\"it's {x}\"\n",
    "def test_a{k}():\n    def test_b():\n        assert 1.5  # yes\n    go()\n",
    # no Python at all
    "def f{k}(x=[]:\n    pass\n",
]
#: The first template that stands in a test module.
TESTS = 18

#: The same in SQL, for the oracles: template t, path p and whether the path is non-source.
CORPUS = f"""
c AS (SELECT p_partkey AS k, p_partkey % {len(TEMPLATES)} AS t,
             CASE WHEN p_partkey % {len(TEMPLATES)} >= {TESTS} THEN 'tests/test_mod_' || p_partkey || '.py'
                  WHEN p_size % 5 = 0 THEN 'examples/mod_' || p_partkey || '.py' ELSE 'src/mod_' || p_partkey || '.py' END AS path,
             p_partkey % {len(TEMPLATES)} >= {TESTS} OR p_size % 5 = 0 AS aside FROM part)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, text, content of the corpus."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_size")
    t = (F.col("k") % len(TEMPLATES)).cast("int")
    text = F.replace(F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), t + 1), F.lit("{k}"), F.col("k").cast("string"))
    path = F.concat(F.when(t >= TESTS, "tests/test_mod_").when(F.col("p_size") % 5 == 0, "examples/mod_").otherwise("src/mod_"), F.col("k").cast("string"), F.lit(".py"))
    return part.select(F.lit("r").alias("repo"), path.alias("path"), text.alias("text"), text.cast("binary").alias("content"))


def parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The node table, parsed once, and the files."""
    source = files(spark, sf_dir)
    return node_table(source), source


def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of two functions and their tests, which use or patch some, for the analyzers that look across files."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    key = F.col("k").cast("string")
    source = part.select(F.concat(F.lit("pkg/mod_"), key, F.lit(".py")).alias("path"), F.concat(F.lit("def load_"), key, F.lit("():\n    return 1\ndef save_"), key, F.lit("():\n    return 2\ndef _own():\n    return 3\n")).alias("text"))
    used = F.when(F.col("k") % 3 == 0, F.concat(F.lit("    save_"), key, F.lit("()\n"))).otherwise("")
    mocked = F.when(F.col("k") % 4 == 0, F.lit("load_")).when(F.col("k") % 4 == 1, F.lit("save_")).otherwise("other_")
    # a nearer module of the same name, which is the target of the tests beside it; and a method, which is no target
    near = part.where("k % 8 = 0").select(F.concat(F.lit("tests/mod_"), key, F.lit(".py")).alias("path"), F.concat(F.lit("class K:\n    def load_"), key, F.lit("(self):\n        return 1\n")).alias("text"))
    test = part.where("k % 2 = 0 OR k % 3 = 0 OR k % 4 = 1").select(
        F.concat(F.lit("tests/test_mod_"), key, F.lit(".py")).alias("path"),
        F.concat(F.lit("def test_load_"), key, F.lit("_ok(mocker):\n    mocker.patch('pkg.mod."), mocked, key, F.lit("')\n"), used, F.lit("    assert load_"), key, F.lit("()\n")).alias("text"),
    )
    return source.unionByName(test).unionByName(near).select(F.lit("r").alias("repo"), "path", "text", F.col("text").cast("binary").alias("content"))


def paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The node table of paired_files, parsed once, and the files."""
    both = paired_files(spark, sf_dir)
    return node_table(both), both
