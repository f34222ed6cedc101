import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def run(spark):
    """Findings of one analyzer over {path: source}, sorted."""
    from treewarden.operators.analyzers import REGISTRY
    from treewarden.operators.nodes import node_table

    def go(analyzer: str, sources: dict[str, str]):
        files = spark.createDataFrame([("r", p, t, bytearray(t.encode())) for p, t in sources.items()], "repo string, path string, text string, content binary")
        return sorted(REGISTRY[analyzer].run(node_table(files), files).collect(), key=lambda r: (r["file"], r["start_line"]))

    return go
