"""Keyed tables in buckets: an update rewrites the buckets that it touches, and one small file makes it count.

A table is ``v=<number>/bucket=<number>`` folders of Parquet and a ``commits`` folder. The newest commit says which version of each
bucket is in force. A run that breaks off before its commit has changed nothing; the next one writes over what it left.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class _Files:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes the file beside its place and renames it; False if another one is there already."""
        beside = self.path(name + ".tmp")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return not self.fs.exists(self.path(name)) and self.fs.rename(beside, self.path(name))


def _newest(files: _Files) -> dict | None:
    found = sorted(n for n in files.names("commits") if n.endswith(".json") and not n.startswith("."))
    return json.loads(files.text(f"commits/{found[-1]}")) if found else None


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch that a stream has committed to the table."""
    commit = _newest(_Files(spark, path))
    return commit and commit["batch"]


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The table as its newest commit has it, or only some of its buckets; None before the first commit."""
    commit = _newest(_Files(spark, path))
    return None if commit is None else _read(spark, path, commit, buckets)


def _read(spark: SparkSession, path: str, commit: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(commit["schema"])
    some = [f"{path.rstrip('/')}/v={v:012d}/bucket={b}" for b, v in commit["versions"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*some) if some else spark.createDataFrame([], schema)


def upsert(new: DataFrame, path: str, key: list[str], latest: str | None = None, buckets: int = BUCKETS, batch: int | None = None) -> int:
    """Puts the rows of new into the table by their key, and returns the commit's number.

    Of new rows with one key that with the greatest ``latest`` counts (without it, the greatest row). Only the buckets that new
    rows fall into are read and written; their numbers, at most ``buckets``, come to the driver. With batch, a
    batch that is committed already changes nothing. Keys may be null. Buckets of a table stay as they were at its first commit.
    """
    spark = new.sparkSession
    files = _Files(spark, path)
    commit = _newest(files) or {"number": 0, "versions": {}, "buckets": buckets, "batch": None, "schema": json.loads(new.schema.json())}
    if batch is not None and commit["batch"] is not None and batch <= commit["batch"]:
        return commit["number"]
    schema = StructType.fromJson(commit["schema"])
    row = F.struct(*(F.col(f"`{f.name}`") for f in schema))
    once = new.groupBy(*key).agg((F.max_by(row, latest) if latest else F.max(row)).alias("__row")).select("__row.*")
    place = F.pmod(F.xxhash64(*key), F.lit(commit["buckets"])).cast("int")
    number, at = commit["number"] + 1, f"{path.rstrip('/')}/v={commit['number'] + 1:012d}"
    touched = sorted(r[0] for r in once.select(place.alias("b")).distinct().collect())
    stored = _read(spark, path, commit, touched)
    names = once.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = stored.join(names, same, "left_anti").unionByName(once)
    spread = rows.withColumn("bucket", place).repartition("bucket")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(at)
    versions = commit["versions"] | {str(b): number for b in touched}
    text = json.dumps(commit | {"number": number, "versions": versions, "batch": commit["batch"] if batch is None else batch})
    if not files.put(f"commits/{number:012d}.json", text):
        raise RuntimeError(f"another writer has made commit {number} of {path}")
    return number


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the versions that the newest commit does not use; not while others read or write the table."""
    files = _Files(spark, path)
    commit = _newest(files)
    used = {f"v={v:012d}" for v in (commit or {"versions": {}})["versions"].values()}
    gone = [n for n in files.names("") if n.startswith("v=") and n not in used]
    for n in gone:
        files.fs.delete(files.path(n), True)
    return gone
