"""Baselines: the ids of known findings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def save(findings: DataFrame, path: str | Path) -> int:
    """Writes the distinct ids of one repository's findings in order, as they come; returns how many. The file takes the old one's place when it is whole."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part, n = Path(f"{path}.part"), 0
    with part.open("w", encoding="utf-8") as out:
        out.write('{\n  "schema": 1,\n  "ids": [')
        for n, r in enumerate(findings.select("id").distinct().orderBy("id").toLocalIterator(), 1):
            out.write(("," if n > 1 else "") + "\n    " + json.dumps(r["id"]))
        out.write("\n  ]\n}" if n else "]\n}")
    part.replace(path)
    return n


def load(spark: SparkSession, path: str | Path) -> DataFrame | None:
    """The ids, or None (not an empty set) if there is no file or it isn't a baseline."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    if not isinstance(data, dict) or not isinstance(data.get("ids"), list):
        return None
    return spark.createDataFrame([(str(i),) for i in data["ids"]], "id string")
