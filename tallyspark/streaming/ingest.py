"""Incremental ingestion: rows and files arrive in folders, each is taken once, touched months are computed anew."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.sources import csv_statements, statements, tables
from tallyspark.streaming.state import durable_state


def ingest_new_rows(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str]) -> None:
    """Appends the rows under source (Parquet) that the checkpoint has not seen to target, one for each key.

    The keys seen stay in the stream's state on disk, without expiry, so a file that is delivered
    again adds nothing. A run that is broken off goes on from the last finished batch.
    """
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates(key)
    with durable_state(spark):
        query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


#: A month's users are dealt to so many parts of the ledger and of its summaries.
PARTS = 16


def refresh_months(
    spark: SparkSession, source: str, schema: str, ledger: str, summaries: str, checkpoint: str, summarize: Callable[[DataFrame], DataFrame], date_col: str = "tx_date", user_col: str = "user_id", parts: int = PARTS
) -> None:
    """Takes new rows under source (Parquet) into the ledger and computes the summaries of what they touch anew.

    The ledger lies in folders by year, month, part of the users and batch; summaries, as summarize gives them for rows of whole
    (user, year, month), by year, month and part. A batch reads and overwrites what it touches alone: its files do not grow with history. A
    batch that is repeated writes over itself. The touched folders' names come to the driver: months times parts. Rows without
    a date are in month 0 of year 0.
    """
    place = ["year", "month", "part"]
    named = lambda df: df.withColumns({
        "year": F.coalesce(F.year(date_col), F.lit(0)), "month": F.coalesce(F.month(date_col), F.lit(0)), "part": F.pmod(F.xxhash64(user_col), F.lit(parts)).cast("int"),
    })

    def each(batch: DataFrame, number: int) -> None:
        new = named(batch).withColumn("batch", F.lit(number))
        _overwrite(new.repartition(*place), ledger, [*place, "batch"])
        touched = [tuple(r) for r in new.select(*place).distinct().collect()]
        if not touched:
            return
        here = reduce(lambda a, b: a | b, (reduce(lambda x, y: x & y, (F.col(c) == v for c, v in zip(place, t, strict=True))) for t in touched))
        rows = spark.read.schema(new.schema).parquet(ledger).where(here)
        _overwrite(named_like(summarize(rows.drop("batch", "part")), user_col, parts).repartition(*place), summaries, place)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def named_like(summary: DataFrame, user_col: str, parts: int) -> DataFrame:
    return summary.withColumn("part", F.pmod(F.xxhash64(user_col), F.lit(parts)).cast("int"))


def _overwrite(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the folders that df has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ingest_statements(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*") -> None:
    """Takes the statement files under folder/<owner>/ that are new: whether they are accepted, which version of an owner's file each is, and their rows.

    target/uploads has every file (upload_id: owner and name with its time), target/csv and target/ofx the rows of those accepted; target/hashes is a
    keyed table of the contents that an owner has sent. A content that was sent before is a new version and its rows are not taken again. A
    batch counts when target/hashes has it; one that broke off before writes over itself. Files that repeat in a batch follow by time and name.
    """
    hashes = f"{target}/hashes"

    def each(batch: DataFrame, number: int) -> None:
        done = tables.last_batch(spark, hashes)
        if done is not None and number <= done:
            return
        seen = statements.accept(batch).withColumns({
            "owner": F.element_at(F.split("path", "/"), -2), "upload_id": F.concat_ws("@", F.array_join(F.slice(F.split("path", "/"), -2, 2), "/"), F.unix_millis("modificationTime").cast("string")), "created_at": F.col("modificationTime"),
        })
        known = tables.read(spark, hashes)
        order = Window.partitionBy("owner", "file_hash").orderBy("created_at", "path")
        facts = seen.drop("content").withColumns({"__k": F.row_number().over(order), "__previous": F.lag("upload_id").over(order)})
        if known is None:
            facts = facts.withColumns({"__version": F.lit(0), "__last": F.lit(None).cast("string")})
        else:
            facts = facts.join(known.select("owner", "file_hash", F.col("version").alias("__version"), F.col("upload_id").alias("__last")), ["owner", "file_hash"], "left")
        facts = facts.withColumns({
            "version": (F.col("__k") + F.coalesce("__version", F.lit(0))).cast("int"), "previous_upload_id": F.coalesce("__previous", "__last"),
        }).drop("__k", "__previous", "__version", "__last")
        _batch(facts, f"{target}/uploads", number)
        uploads = spark.read.schema(facts.schema).parquet(f"{target}/uploads/batch={number}")
        first = uploads.where("reason IS NULL AND version = 1").select("path", F.col("upload_id").alias("file"), "owner", F.col("kind").alias("as"))
        texts = batch.select("path", statements.decoded(F.col("content")).alias("text")).join(first, "path")
        _batch(csv_statements.read_statements(texts.where("as = 'CSV'").select("file", "owner", "text"), ["file"]), f"{target}/csv", number)
        _batch(statements.ofx_transactions(texts.where("as IN ('OFX', 'QFX', 'QBO')").select("file", "text")), f"{target}/ofx", number)
        tables.upsert(uploads.select("owner", "file_hash", "version", "upload_id"), hashes, ["owner", "file_hash"], "version", batch=number)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _batch(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def repeats_within_watermark(events: DataFrame, key: list[str], time_col: str = "ts", delay: str = "2 days") -> DataFrame:
    """A stream without rows whose key came less than the delay before."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)
