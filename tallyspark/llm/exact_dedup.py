"""Exact dedup as a stateful stream: keyed state on disk, without expiry.

State for each content digest: the stable identifier of the row that stays (the
largest), the number of rows, and the locator of the content seen first (file and row in
it). Where a digest hits, the bytes there are compared. DataFrame functions only.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import scratch, text_of, written

# Files are asked for by cells of their names' hashes. With more files than cells, files of one cell are read together.
FILE_CELLS = 1 << 16

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no space is set aside for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pattern_of(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(path without a trailing slash, its pattern characters escaped, whether it is a folder)."""
    path = path.rstrip("/") or "/"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path), folder


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, file, row, added): the digest of the whole text, where the text is, and when its file was written."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.col("_metadata.file_modification_time").alias("added"),
    )


def _run(frame: DataFrame, mode: str, checkpoint: str, **sink: str) -> None:
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**sink)
    writer.format("parquet" if sink else "noop").trigger(availableNow=True).start().awaitTermination()


def update_state(
    spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", max_files: int = 4096
) -> None:
    """Streams the Parquet rows under path that the checkpoint has not seen into its state.

    Run it again after files were added: only those are read. Three steps, each with
    progress of its own, so one that an executor's loss breaks off goes on from its last
    finished micro-batch: texts become entries (identifier, digest, locator); entries
    go into the state; full bytes are compared where a digest hits.
    """
    pattern, folder = pattern_of(spark, path)
    schema = spark.read.parquet(pattern).select(id_col, text_col).schema
    # a stream's pattern may match a file or a folder; a plain path must be a folder
    source = pattern if folder else f"{pattern[:-1]}[{pattern[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    _run(digests(stream, id_col, text_col), "append", f"{checkpoint}/entries-progress", path=f"{checkpoint}/entries")
    with _settings(spark, STATE_STORE):
        found = entries(spark, checkpoint)
        arriving = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", max_files).parquet(f"{checkpoint}/entries")
        kept = arriving.groupBy("digest").agg(
            F.max("id").alias("keep_id"),
            F.count("*").alias("group_size"),
            # files that come later were written later, so the locator stays
            F.min_by(F.struct("file", "row"), F.struct("added", "file", "row")).alias("locator"),
        )
        _run(kept, "update", f"{checkpoint}/state")
    _compare_hits(spark, pattern, checkpoint, text_col)


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, digest, file, row, added) of all rows seen."""
    return spark.read.parquet(f"{checkpoint}/entries")


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_id, group_size, file, row): the state as it stands. file and row locate the content seen first."""
    with _settings(spark, STATE_STORE):
        found = spark.read.format("statestore").load(f"{checkpoint}/state")
    names = [f.name for f in found.schema["value"].dataType.fields]
    largest, size, place = names[0], names[1], names[2]
    return found.select(
        F.col("key")[found.schema["key"].dataType.fields[0].name].alias("digest"),
        F.col("value")[largest].alias("keep_id"),
        F.col("value")[size].alias("group_size"),
        F.col("value")[place]["file"].alias("file"),
        F.col("value")[place]["row"].alias("row"),
    )


def _table(spark: SparkSession, path: str, column: str, kind: str) -> DataFrame:
    """The table at path; an empty one if nothing was written there yet."""
    none = spark.range(0).select(F.lit(None).cast(kind).alias(column))
    none.write.mode("append").parquet(path)
    return spark.read.schema(none.schema).parquet(path)


def _cell(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(FILE_CELLS))


def _contents(spark: SparkSession, pattern: str, asked: DataFrame, text_col: str) -> DataFrame:
    """asked (digest, file, row) and the content found there. Only files of cells that are asked for are read; which
    these are goes through the driver, FILE_CELLS numbers at most."""
    docs = spark.read.parquet(pattern)
    texts = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text_of(text_col).alias("content"))
    cells = [r.cell for r in asked.select(_cell(F.col("file")).alias("cell")).distinct().collect()]
    # both sides grow with the corpus: the join shuffles at every size, and sorts no text
    return texts.where(_cell(F.col("file")).isin(cells)).join(asked.hint("shuffle_hash"), ["file", "row"])


def _compare_hits(spark: SparkSession, pattern: str, checkpoint: str, text_col: str) -> None:
    """Compares full bytes of the rows whose digest was there already with the content that the state locates; adds the digests of
    unequal contents to the checkpoint's collisions. Entries come as a stream, so each is compared in the update that brings it and
    not read again. One copy of a content leaves a task, so a text that a third of all rows have moves once a task."""

    def compare(new: DataFrame, _: int) -> None:
        session = new.sparkSession
        kept = state(session, checkpoint).where("group_size > 1").select("digest", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))
        hits = written(new.join(kept, "digest").where("file <> keep_file OR row <> keep_row"), "exact-hits")
        located = hits.select("digest", F.col("keep_file").alias("file"), F.col("keep_row").alias("row")).distinct()
        asked = written(hits.select("digest", "file", "row").union(located), "exact-asked")
        kinds = _contents(session, pattern, asked, text_col).groupBy("digest", "content").count()
        unequal = kinds.groupBy("digest").agg(F.count("*").alias("kinds")).where("kinds > 1").select("digest")
        # a batch that an executor's loss repeats adds its digests again; readers take each once
        unequal.write.mode("append").parquet(f"{checkpoint}/collisions")

    found = entries(spark, checkpoint)
    arriving = spark.readStream.schema(found.schema).parquet(f"{checkpoint}/entries").select("digest", "file", "row")
    # without a limit of files all that is new is one batch, which reads the state once
    arriving.writeStream.foreachBatch(compare).option("checkpointLocation", f"{checkpoint}/compared").trigger(availableNow=True).start().awaitTermination()


def exact_duplicates(
    spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of the Parquet table at path: doc_id, keep_id, group_size, kept, digest, keep_file, keep_row.

    Texts are equal when their bytes are; null counts as empty. The largest
    identifier of equal texts stays. Null identifiers are smaller than all others.
    Rows that repeat an identifier and a text share its result. An empty table gives
    an empty result. With a checkpoint that has seen some of the files, only new ones
    are read; the result covers all.

    keep_file and keep_row locate the content of the group that was seen first.

    Full bytes decide, compared where a digest hits. A digest with several contents is
    a collision, and its rows are grouped by the content itself.
    """
    checkpoint = checkpoint or scratch(spark, "exact-state")
    update_state(spark, path, checkpoint, id_col, text_col)
    rows = entries(spark, checkpoint)
    kept = state(spark, checkpoint).withColumnsRenamed({"file": "keep_file", "row": "keep_row"})
    unequal = _table(spark, f"{checkpoint}/collisions", "digest", "binary").distinct()
    columns = ["id", "digest", "keep_id", "group_size", "keep_file", "keep_row"]
    if unequal.isEmpty():
        joined = rows.join(kept, "digest").select(columns)
    else:
        asked = written(rows.join(unequal, "digest", "left_semi"), "collisions")
        found = written(_contents(spark, pattern_of(spark, path)[0], asked, text_col), "collision-contents")
        groups = found.groupBy("digest", "content").agg(
            F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.min_by(F.struct("file", "row"), F.struct("added", "file", "row")).alias("at")
        )
        groups = groups.select("digest", "content", "keep_id", "group_size", F.col("at.file").alias("keep_file"), F.col("at.row").alias("keep_row"))
        joined = rows.join(unequal, "digest", "left_anti").join(kept, "digest").select(columns)
        joined = joined.unionByName(found.join(groups, ["digest", "content"]).select(columns))
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_file", "keep_row"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text) AS keep_id,
       (count(*) OVER (PARTITION BY text))::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
       sha256(text) AS text_sha256
FROM texts
"""
