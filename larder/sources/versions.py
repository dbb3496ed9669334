"""Tables that change by whole versions: a version is seen when its manifest is written, and never in part."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer was faster."""


class Versions:
    """Numbered manifests below ``root``. Data are written first, below folders() of their own; commit() makes them the
    next version. A manifest that is not whole counts as not written, so a writer that stops anywhere changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._path("versions")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, n: int) -> dict | None:
        path, fs = self._path(f"versions/{n:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and content of the newest whole manifest; (0, {}) before the first."""
        for n in reversed(self._numbers()):
            content = self._manifest(n)
            if content is not None:
                return n, content
        return 0, {}

    def folder(self) -> str:
        """A name below root that no version uses."""
        return f"data/{uuid.uuid4().hex}"

    def commit(self, content: dict, after: int) -> int:
        """Make ``content`` the next version if ``after`` is still the latest."""
        if self.latest()[0] != after:
            raise Conflict(f"version {after} of {self.root} is no longer the latest")
        n = max(self._numbers(), default=0) + 1
        path, fs = self._path(f"versions/{n:010d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"version {n} of {self.root} is already there") from e
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return n


def write_version(tables: dict[str, DataFrame], root: str) -> int:
    """Write all tables as one version and return its number: readers see all of them or none."""
    versions = Versions(next(iter(tables.values())).sparkSession, root)
    after, _ = versions.latest()
    folder = versions.folder()
    for name, table in tables.items():
        table.write.parquet(f"{versions.root}/{folder}/{name}")
    return versions.commit({name: {"path": f"{folder}/{name}", "schema": table.schema.json()} for name, table in tables.items()}, after)


def read_version(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the latest version; none before the first. What was read stays as it is while others write."""
    versions = Versions(spark, root)
    return {name: spark.read.schema(T.StructType.fromJson(json.loads(t["schema"]))).parquet(f"{versions.root}/{t['path']}") for name, t in versions.latest()[1].items()}


class DetailCache:
    """Details by id that grow by flushes. A flush writes its own rows; FANOUT runs of a level are merged into one of the
    next, so n flushes write each row about log(n) times. Null details are known misses and are kept."""

    FANOUT = 4

    def __init__(self, spark: SparkSession, root: str, details: str):
        self.versions, self.spark = Versions(spark, root), spark
        self.schema = T.StructType().add("id", "string").add("detail", T._parse_datatype_string(details))

    def _read(self, runs: list[dict]) -> DataFrame:
        """(id, detail, turn) of the runs; a later turn is newer."""
        rows = self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("turn", T.LongType())])) if not runs else None
        for run in runs:  # a few for each level
            one = self.spark.read.schema(self.schema).parquet(f"{self.versions.root}/{run['path']}").withColumn("turn", F.lit(run["turn"]).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def _newest(self, runs: list[dict]) -> DataFrame:
        return self._read(runs).groupBy("id").agg(F.max_by(F.struct("detail"), "turn").alias("d")).select("id", "d.detail")

    def _write(self, rows: DataFrame, level: int, turn: int) -> dict:
        run = {"path": self.versions.folder(), "level": level, "turn": turn}
        rows.write.parquet(f"{self.versions.root}/{run['path']}")
        return run

    def runs(self) -> list[dict]:
        return self.versions.latest()[1].get("runs", [])

    def flush(self, fetched: DataFrame) -> None:
        """Add rows (id, detail); they replace older ones. Rows without an id are left out; of rows that repeat an id the
        one with the greatest detail counts."""
        after, content = self.versions.latest()
        turn, runs = content.get("turn", 0) + 1, content.get("runs", [])
        once = fetched.where("id is not null").groupBy("id").agg(F.max("detail").alias("detail"))
        runs = [*runs, self._write(once, 0, turn)]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.FANOUT:
            level += 1
            runs = [r for r in runs if r not in full] + [self._write(self._newest(full), level, full[-1]["turn"])]
        self.versions.commit({"turn": turn, "runs": runs}, after)

    def rows(self) -> DataFrame:
        """(id, detail) of all known ids."""
        return self._newest(self.runs())

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (id, ...) whose id is not known, not even as a miss."""
        return wanted.join(self._read(self.runs()).select("id"), "id", "left_anti")
