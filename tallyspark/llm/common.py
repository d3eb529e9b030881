"""What the corpus operators share: tables, the shared folder, written intermediates, classes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a session in one local
    process may go without: it gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="tallyspark-")
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver's process ends, be its session stopped by then or not."""
    path = f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # outlives the session

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM has ended already
            files.delete(at, True)

    atexit.register(remove)
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected classes of the links (a, b): rows (node, component), the smallest node.

    Alternating large-star and small-star rounds; each is a group-by minimum and a
    join on the node, and each is written to the shared folder. A node that is in
    no link has no row. Self links count as a node on its own. Nulls are left out.

    A hub's links stay skewed for the join alone, which Spark may split; minima
    are combined before the shuffle.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = links.select("a").union(links.select("b")).distinct()
    current = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    while True:
        # large star: every neighbour that is larger than the node goes to the node's minimum
        both = current.union(current.select(F.col("b"), F.col("a")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.distinct(), "large-star")
        # small star: the smaller neighbours of a node, and the node, go to their minimum
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("x"), "low")
            .where("x <> low")
            .select(F.col("x").alias("a"), F.col("low").alias("b"))
        )
        following = written(small.distinct(), "small-star")
        # it is done once every node points at one root and no root points further
        several = following.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        onward = following.join(following.select(F.col("a").alias("b")), "b", "left_semi")
        if several.isEmpty() and onward.isEmpty():
            break
        current = following
    roots = following.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select(F.col("a").alias("node")).join(roots, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def slices(batch, column: int, most: int = 8 << 20):
    """The batch in runs of rows whose values in a text column have about so many bytes; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
