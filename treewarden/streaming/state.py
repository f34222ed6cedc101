"""Facts and findings by version, kept up by what a change touches.

A folder holds tables with a folder for each version. A version adds rows of the files that changed, and a narrow manifest names for every
present file the version that holds its rows. Analyzers that look across files are kept up by key: facts lie in buckets of their keys, so the
facts of touched keys alone are read and judged, once as they were and once as they are; files whose rows differ get new findings, all others keep theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import __version__
from ..functions.scratch import folders, merging, remove, written
from .changes import editor_temp, snapshot_diff

#: What the tables of a state look like; a state of another number or engine is not read.
STATE_SCHEMA = 3
KEYS = ["repo", "path"]
STATE = "schema int, engine string, mode string, reindexed long, removed long, new long, gone long, buckets int, base map<string,bigint>, keyed array<string>, ran long, needs array<bigint>, touched long, judged long"
MANIFEST = "repo string, path string, mtime double, held bigint, judged map<string,bigint>"
#: Tables whose rows lie in buckets.
DEALT = ("facts-", "keys-", "rows-")
#: Conditions of reading what is damaged or gone, as against faults of other kinds.
DAMAGED = ("FAILED_READ_FILE", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ")


def damaged(e: Exception) -> bool:
    """Whether an error says that a table is missing, broken or of another shape."""
    condition = (e.getCondition() or "") if isinstance(e, PySparkException) else ""
    return condition.startswith(DAMAGED) or any(x in str(e) for x in ("is not a Parquet file", "FileNotFoundException", "CANNOT_READ_FILE_FOOTER"))


class Incremental:
    """The state in ``folder``.

    The state row of a version is written last, so a version counts when all of it is there. Versions are numbered by the folders that exist, whole or not, and no number is
    used twice. A newest state that can't be read, or of another schema or engine, is refused: the next scan is cold, and its version is the newest from then on.

    A version is compacted into one that holds all current rows when its rows lie in more than ``compact_beyond`` versions. Of all versions the last ``keep`` stay, those that
    are pinned, and the folders that hold rows of these; others are deleted after a scan. Readers of older versions pin them first.
    """

    def __init__(self, spark, folder: str, keep: int = 12, compact_beyond: int = 12, buckets: int = 64):
        self.spark, self.folder, self.keep, self.compact_beyond, self.buckets = spark, folder.rstrip("/"), keep, compact_beyond, buckets

    # tables and versions

    def _at(self, what: str, version: int) -> str:
        return f"{self.folder}/{what}/version={version}"

    def _versions(self, what: str) -> list[int]:
        return sorted(int(x.split("=")[1]) for x in folders(self.spark, f"{self.folder}/{what}") if x.startswith("version="))

    def _write(self, df: DataFrame, what: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(what, version))
        return self.spark.read.schema(df.schema).parquet(self._at(what, version))

    def _write_dealt(self, df: DataFrame, what: str, version: int, by: list[str]) -> None:
        """Rows in a folder for each bucket of ``by``; rows of one large bucket are written by several tasks."""
        rows = df.withColumn("bucket", self._bucket(by)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *by)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._at(what, version))

    def _bucket(self, by: list[str]) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def _read(self, what: str, schema, versions, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the versions given, with the number of each, and of the buckets given; folders of others aren't listed."""
        there = set(self._versions(what))
        paths = [self._at(what, v) for v in versions if v in there]
        extra = [("version", "long"), *([("bucket", "integer")] if buckets is not None else [])]
        schema = StructType([*[f for f in schema.fields if f.name not in dict(extra)]])
        for name, kind in extra:
            schema = schema.add(name, kind)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{what}").parquet(*paths)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _schema(self, what: str):
        """The columns that a table had when it was last written; none if it never had a row in buckets."""
        for version in reversed(self._versions(what)):
            if not what.startswith(DEALT) or folders(self.spark, self._at(what, version)):
                return self.spark.read.parquet(self._at(what, version)).drop("bucket").schema
        return StructType([])

    @staticmethod
    def _numbers(rows: DataFrame, column: str) -> list[int]:
        """The distinct versions or buckets of a column; as few as there are folders."""
        return sorted(r[0] for r in rows.select(column).distinct().collect() if r[0] is not None)

    # states

    def _newest(self) -> int:
        """The highest version that has left a folder, whole or not; 0 without any."""
        return max([0, *[v for what in folders(self.spark, self.folder) for v in self._versions(what)]])

    def load(self) -> dict | None:
        """The newest whole version's state. None without one, or if it can't be trusted."""
        versions = self._versions("state")
        if not versions:
            return None
        try:
            row = self.spark.read.schema(STATE).parquet(self._at("state", versions[-1])).first()
            if row is None or (row["schema"], row["engine"]) != (STATE_SCHEMA, __version__):
                return None
            self.manifest(versions[-1]).agg(F.sum("held"), F.max("path")).first()
            self._read("local", self._schema("local"), row["needs"]).head(1)
            return {"version": versions[-1]} | row.asDict()
        except Exception as e:
            if damaged(e):
                return None
            raise

    def _state(self, version: int | None) -> dict | None:
        if version is None:
            return self.load()
        return {"version": version} | self.spark.read.schema(STATE).parquet(self._at("state", version)).first().asDict()

    def manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(self._at("manifest", version))

    def feed(self, most: int = 12) -> DataFrame:
        """The last versions: version, mode, reindexed, removed, new, gone."""
        last = self._versions("state")[-most:]
        rows = self.spark.read.schema(STATE + ", version bigint").option("basePath", f"{self.folder}/state").parquet(*[self._at("state", v) for v in last])
        return rows.select("version", "mode", "reindexed", "removed", "new", "gone").orderBy(F.desc("version"))

    # current rows

    def _current(self, what: str, manifest: DataFrame, path: str = "path") -> DataFrame:
        """Rows of the present files, each from the version that its manifest row names."""
        held = manifest.select("repo", F.col("path").alias(path), F.col("held").alias("version"))
        return self._read(what, self._schema(what), self._numbers(held, "version")).join(merging(held), ["repo", path, "version"], "left_semi").drop("version")

    def _judged(self, what: str, analyzer: str, manifest: DataFrame, path: str = "path") -> DataFrame:
        """An analyzer's rows of the present files, each file's from the version that judged it last."""
        at = manifest.select("repo", F.col("path").alias(path), F.col("judged")[analyzer].alias("version")).where("version IS NOT NULL")
        return self._read(what, self._schema(what), self._numbers(at, "version")).join(merging(at), ["repo", path, "version"], "left_semi").drop("version")

    def findings(self, version: int | None = None) -> DataFrame:
        """Findings of a version, the last one by default."""
        state = self._state(version)
        manifest = self.manifest(state["version"])
        parts = [self._current("local", manifest, "file"), self.spark.read.parquet(self._at("cross", state["ran"]))]
        parts += [self._judged(f"found-{a}", a, manifest, "file").drop("bucket") for a in state["keyed"]]
        return reduce(DataFrame.unionByName, parts)

    def errors(self, version: int | None = None) -> DataFrame:
        """(repo, path, kind, message) of the files that couldn't be read or parsed when they last changed, and (null, analyzer, ...) of analyzers that failed when they last ran."""
        state = self._state(version)
        return self._current("errors", self.manifest(state["version"])).unionByName(self.spark.read.parquet(self._at("failed", state["ran"])))

    # a scan

    def scan(self, listed: DataFrame, force_full: bool = False) -> dict:
        """One version of the trees whose files are ``listed`` (as of full_scan): files whose time differs from the manifest's are read and parsed, those that are gone drop out. Returns the new state.

        A file that can't be read or parsed is remembered with its error and not tried again until it is touched. An analyzer that fails leaves an error; its findings stay as they
        were, but for files that are gone, and the next scan judges it anew as a whole. Tables found damaged on the way make the scan cold.
        """
        before = None if force_full else self.load()
        try:
            state = self._scan(listed, before)
        except Exception as e:
            if not (before and damaged(e)):
                raise
            state = self._scan(listed, None)
        if len(state["needs"]) > self.compact_beyond:
            self.compact()
        self.expire(state["version"])
        return state

    def _scan(self, listed: DataFrame, before: dict | None) -> dict:
        from ..sources.files import with_content

        present = listed.where(~editor_temp(F.col("path")))
        old = self.manifest(before["version"]) if before else None
        changes = snapshot_diff(old, present, tuple(KEYS), "mtime") if before else present.select(*KEYS, F.lit("added").alias("status"))
        changes = written(changes, "changes")
        read = written(with_content(present.join(merging(changes.where("status != 'deleted'")), KEYS, "left_semi")), "read")
        return self.apply(read, changes, present, before)

    def apply(self, read: DataFrame, changes: DataFrame, present: DataFrame, before: dict | None) -> dict:
        """A version from what changed since ``before``: ``read`` (repo, path, text, content, error) of added and modified files, ``changes`` (repo, path, status), and ``present`` (repo, path, mtime) of all files."""
        from ..operators.analyzers import REGISTRY
        from ..operators.findings import analyze, analyze_apart
        from ..operators.nodes import nodes, parse_errors

        spark, version = self.spark, self._newest() + 1
        self.buckets = before["buckets"] if before else self.buckets
        counts = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        held = present.select(*KEYS, F.col("mtime").cast("double").alias("mtime")).join(merging(changes.select(*KEYS, "status")), KEYS, "left").withColumn("held", F.when(F.col("status").isNotNull(), F.lit(version).cast("bigint")))
        if before:
            held = held.join(merging(self.manifest(before["version"]).select(*KEYS, F.col("held").alias("was"), "judged")), KEYS, "left").withColumn("held", F.coalesce("held", "was"))
        else:
            held = held.withColumn("judged", F.lit(None).cast("map<string,bigint>"))
        manifest = written(held.select(*KEYS, "mtime", "held", F.coalesce("judged", F.create_map().cast("map<string,bigint>")).alias("judged")), "manifest")
        whole = [n for n, a in REGISTRY.items() if a.cross_file and a.keyed is None]
        keyed = [n for n, a in REGISTRY.items() if a.keyed is not None]
        base = {n: b for n, b in (before["base"] if before else {}).items() if n in keyed}
        state = {"schema": STATE_SCHEMA, "engine": __version__, "mode": "warm" if before else "cold", "reindexed": counts.get("added", 0) + counts.get("modified", 0), "removed": counts.get("deleted", 0), "new": 0, "gone": 0, "buckets": self.buckets, "touched": 0, "judged": 0}
        if before and not counts and not self.spark.read.parquet(self._at("failed", before["ran"])).head(1) and set(keyed) == set(base):
            self._write(manifest, "manifest", version)
            return self._finish(version, state | {k: before[k] for k in ("base", "keyed", "ran")}, manifest)

        readable = read.where("error IS NULL").select(*KEYS, "text", "content")
        fresh_files = self._write(readable, "files", version)
        fresh = self._write(nodes(fresh_files), "nodes", version)
        broken = parse_errors(fresh).select(*KEYS, F.lit("SyntaxError").alias("kind"), "message")
        self._write(broken.unionByName(read.where("error IS NOT NULL").select(*KEYS, F.substring_index("error", ":", 1).alias("kind"), F.substring("error", 1, 200).alias("message"))), "errors", version)
        found, failed = analyze_apart(fresh, fresh_files, [n for n, a in REGISTRY.items() if not a.cross_file])
        empty = spark.createDataFrame([], analyze(fresh, fresh_files, list(REGISTRY)[:1]).schema)
        self._write(reduce(DataFrame.unionByName, found.values(), empty), "local", version)

        all_rows = lambda what: self._current(what, manifest)
        across, more = analyze_apart(all_rows("nodes"), all_rows("files"), whole) if whole else ({}, [])
        lost = [e["analyzer_id"] for e in more]
        kept = [spark.read.parquet(self._at("cross", before["ran"])).where(F.col("analyzer_id").isin(lost))] if before and lost else []
        self._write(reduce(DataFrame.unionByName, [*across.values(), *kept], empty), "cross", version)

        judged = {n: None for n in (before["keyed"] if before else []) if n in REGISTRY and n not in across}
        for name in keyed:
            try:
                if name in base:
                    judged[name], touched, facts = self._rejudge(name, version, base[name], manifest, self.manifest(before["version"]), changes, fresh, fresh_files)
                    state["touched"], state["judged"] = state["touched"] + touched, state["judged"] + facts
                else:
                    self._judge_all(name, version, all_rows("nodes"), all_rows("files"))
                    base[name], judged[name] = version, manifest.select(*KEYS)
            except Exception as e:  # whatever an analyzer raises, in planning or in a task
                if damaged(e):
                    raise
                more.append({"analyzer_id": name, "kind": type(e).__name__, "message": str(e)[:200]})
                base.pop(name, None)
        self._write(spark.createDataFrame([(None, e["analyzer_id"], e["kind"], e["message"]) for e in failed + more], "repo string, path string, kind string, message string"), "failed", version)
        for name in {*(before["keyed"] if before else []), *judged}:
            manifest = self._mark(manifest, name, judged.get(name), version, drop=name not in judged)
        manifest = self._write(manifest, "manifest", version)
        state |= {"base": base, "keyed": sorted(judged), "ran": version}
        then = self.findings(before["version"]).select("id").distinct() if before else empty.select("id")
        return self._finish(version, state, manifest, then)

    @staticmethod
    def _mark(manifest: DataFrame, name: str, files: DataFrame | None, version: int, drop: bool) -> DataFrame:
        """The manifest with the version of the files that an analyzer has judged now."""
        without = F.map_filter("judged", lambda k, v: k != name)
        if drop:
            return manifest.withColumn("judged", without)
        if files is None:
            return manifest
        now = F.map_concat(without, F.create_map(F.lit(name), F.lit(version).cast("bigint")))
        return manifest.join(merging(files.select(*KEYS, F.lit(True).alias("_now"))), KEYS, "left").withColumn("judged", F.when(F.col("_now"), now).otherwise(F.col("judged"))).drop("_now")

    def _finish(self, version: int, state: dict, manifest: DataFrame, then: DataFrame | None = None) -> dict:
        """Writes the state row, which makes the version count."""
        rows = manifest.select(F.explode(F.concat(F.array("held"), F.map_values("judged"))).alias("v"))
        state["needs"] = sorted({*self._numbers(rows, "v"), *state["base"].values(), state["ran"]})
        if then is not None:
            now = reduce(DataFrame.unionByName, [self._current("local", manifest, "file"), self.spark.read.parquet(self._at("cross", state["ran"])), *[self._judged(f"found-{a}", a, manifest, "file").drop("bucket") for a in state["keyed"]]]).select("id").distinct()
            sides = now.withColumn("side", F.lit(1)).unionAll(then.withColumn("side", F.lit(-1))).groupBy("id").agg(F.sum("side").alias("side"))
            state["new"], state["gone"] = sides.agg(F.count_if(F.col("side") == 1), F.count_if(F.col("side") == -1)).first()
        names = [x.split()[0] for x in STATE.split(", ")]
        self.spark.createDataFrame([tuple(state[n] for n in names)], STATE).coalesce(1).write.mode("overwrite").parquet(self._at("state", version))
        return {"version": version} | state

    # analyzers kept up by key

    def _store(self, name: str, version: int, facts: DataFrame) -> DataFrame:
        """Writes facts by buckets of keys, and each file's keys by buckets of files."""
        self._write_dealt(facts, f"facts-{name}", version, ["repo", "key"])
        facts = self._read(f"facts-{name}", facts.schema, [version], list(range(self.buckets)))
        self._write_dealt(facts.groupBy(*KEYS).agg(F.collect_set("key").alias("keys")), f"keys-{name}", version, KEYS)  # one file's keys
        return facts.drop("version", "bucket")

    def _settle(self, name: str, version: int, rows: DataFrame) -> None:
        """Writes judged rows by file, and the findings they make."""
        from ..functions.identity import finding_ids
        from ..operators.analyzers import REGISTRY

        self._write_dealt(rows, f"rows-{name}", version, KEYS)
        rows = self._read(f"rows-{name}", rows.schema, [version], list(range(self.buckets))).drop("version", "bucket")
        found = REGISTRY[name].finish(REGISTRY[name].keyed.settle(rows)).withColumn("id", finding_ids("analyzer_id", "analyzer_version", "symbol", "file", "evidence"))
        self._write(found, f"found-{name}", version)

    def _judge_all(self, name: str, version: int, nodes: DataFrame, files: DataFrame) -> None:
        from ..operators.analyzers import REGISTRY

        keyed = REGISTRY[name].keyed
        self._settle(name, version, keyed.judge(self._store(name, version, keyed.facts(nodes, files))))

    def facts_of(self, name: str, schema, base: int, keys: DataFrame, buckets: list[int], manifest: DataFrame) -> DataFrame:
        """The facts of touched ``keys`` in the files of a manifest; only their buckets are read, of the versions that hold present files."""
        held = manifest.select(*KEYS, F.greatest("held", F.lit(base)).alias("version"))
        facts = self._read(f"facts-{name}", schema, self._numbers(held, "version"), buckets)
        return facts.join(merging(keys.select("repo", "key")), ["repo", "key"], "left_semi").join(merging(held), [*KEYS, "version"], "left_semi").drop("version", "bucket")

    def _rejudge(self, name: str, version: int, base: int, manifest: DataFrame, before: DataFrame, changes: DataFrame, fresh: DataFrame, fresh_files: DataFrame) -> tuple[DataFrame, int, int]:
        """Judges the touched keys alone. Returns the files whose findings were made anew, and how many keys and facts that took."""
        from ..operators.analyzers import REGISTRY

        keyed = REGISTRY[name].keyed
        facts = self._store(name, version, keyed.facts(fresh, fresh_files))
        schema = facts.schema
        gone = written(before.join(merging(changes.select(*KEYS)), KEYS, "left_semi").select(*KEYS, F.greatest("held", F.lit(base)).alias("version"), self._bucket(KEYS).alias("bucket")), "gone")
        had = self._read(f"keys-{name}", facts.select(*KEYS, F.array("key").alias("keys")).schema, self._numbers(gone, "version"), self._numbers(gone, "bucket"))
        old = had.join(merging(gone), [*KEYS, "version"], "left_semi").select("repo", F.explode("keys").alias("key"))
        keys = written(old.unionByName(facts.select("repo", "key")).distinct().withColumn("bucket", self._bucket(["repo", "key"])), "touched")
        buckets = self._numbers(keys, "bucket")
        facts_now = written(self.facts_of(name, schema, base, keys, buckets, manifest), "facts")
        now = written(keyed.judge(facts_now), "judged")
        was = keyed.judge(self.facts_of(name, schema, base, keys, buckets, before)).select(now.columns)
        both = now.withColumn("_side", F.lit(1)).unionAll(was.withColumn("_side", F.lit(-1)))
        differ = both.groupBy(*now.columns).agg(F.sum("_side").alias("_side")).where("_side != 0")
        files = written(differ.select(*KEYS).distinct().join(merging(manifest.select(*KEYS, F.col("judged")[name].alias("version"))), KEYS).withColumn("bucket", self._bucket(KEYS)), "files")
        rest = self._read(f"rows-{name}", now.schema, self._numbers(files, "version"), self._numbers(files, "bucket")).join(merging(files.select(*KEYS, "version")), [*KEYS, "version"], "left_semi").drop("version", "bucket").join(merging(keys.select("repo", "key")), ["repo", "key"], "left_anti")
        self._settle(name, version, rest.select(now.columns).unionByName(now.join(merging(files.select(*KEYS)), KEYS, "left_semi").select(now.columns)))
        return files, keys.count(), facts_now.count()

    # compaction and expiry

    def compact(self) -> int:
        """Writes all rows of the newest version again as a version of their own, so that none is held by an older one. Returns its number."""
        before = self.load()
        version, manifest = self._newest() + 1, self.manifest(before["version"])
        for what, path in (("files", "path"), ("nodes", "path"), ("errors", "path"), ("local", "file")):
            self._write(self._current(what, manifest, path), what, version)
        for what in ("cross", "failed"):
            self._write(self.spark.read.parquet(self._at(what, before["ran"])), what, version)
        for name in before["keyed"]:
            self._write(self._judged(f"found-{name}", name, manifest, "file"), f"found-{name}", version)
            if name in before["base"] and self._schema(f"rows-{name}").names:
                self._write_dealt(self._judged(f"rows-{name}", name, manifest).drop("bucket"), f"rows-{name}", version, KEYS)
            if name in before["base"] and self._schema(f"facts-{name}").names:
                held = manifest.select(*KEYS, F.greatest("held", F.lit(before["base"][name])).alias("version"))
                facts = self._read(f"facts-{name}", self._schema(f"facts-{name}"), self._numbers(held, "version"), list(range(self.buckets)))
                self._store(name, version, facts.join(merging(held), [*KEYS, "version"], "left_semi").drop("version", "bucket"))
        now = F.lit(version).cast("bigint")
        manifest = self._write(manifest.select(*KEYS, "mtime", now.alias("held"), F.transform_values("judged", lambda k, v: now).alias("judged")), "manifest", version)
        state = before | {"mode": "compact", "reindexed": 0, "removed": 0, "new": 0, "gone": 0, "touched": 0, "judged": 0, "base": dict.fromkeys(before["base"], version), "ran": version}
        self._finish(version, {k: v for k, v in state.items() if k != "version"}, manifest)
        return version

    def pin(self, version: int) -> None:
        """Keeps a version, and what holds its rows, until it is unpinned."""
        self._write(self.spark.createDataFrame([(version,)], "pinned long").coalesce(1), "pins", version)

    def unpin(self, version: int) -> None:
        remove(self.spark, self._at("pins", version))

    def expire(self, *also: int) -> list[int]:
        """Deletes versions that are neither among the last ``keep`` nor pinned nor named, and folders that hold rows of no version that stays. Returns the versions that stay."""
        whole = self._versions("state")
        stay = sorted({*whole[-self.keep :], *set([*also, *self._versions("pins")]).intersection(whole)})
        needed = {v for version in stay for v in self._state(version)["needs"]}
        last = self._newest()
        for what in folders(self.spark, self.folder):
            for version in self._versions(what):
                if what != "pins" and version < last and version not in (stay if what in ("state", "manifest") else needed):
                    remove(self.spark, self._at(what, version))
        return stay
