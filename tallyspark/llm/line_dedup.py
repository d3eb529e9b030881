"""Line dedup: keep bitmaps for each document, from a range-partitioned sort of line hashes.

DataFrame functions only. Lines travel as two hashes with document and position,
never as text; one bitmap a document comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(value: Column) -> Column:
    """A-Z only. A string of one-byte characters takes the faster function."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, body, pos, h1, h2) of the lines whose key is long enough."""
    lines = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_of(text_col)).alias("body"),
        F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "line"),
    ).select("doc", "body", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(
        "doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2")
    )


def drop_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """(doc, body, drops map<int, long>): set bits of word ``pos div 64`` are lines that go.

    A line goes, in every document, when its key is found in ``min_docs`` documents
    or more. A document is an id with a text: repeated rows count once. Documents
    that keep all lines have no row.

    The hashes are range-partitioned by (hash, document), so a line that stands in a
    third of all documents is spread over many tasks; within a partition they are
    sorted by document and position, and only the first occurrence in a document
    counts. A partition sends one count of each of its keys, and learns which of them
    go: no key's lines meet in one task. Two 64-bit hashes name a key, and a 64-bit
    hash with the id a document; bytes are not compared. The hashes are written
    once: finding the ranges reads them, and splits no text again.
    """
    hashed = written(_lines(docs, id_col, text_col, min_chars), "line-hashes")
    ranged = hashed.repartitionByRange("h1", "h2", "doc", "body")
    in_doc = Window.partitionBy("h1", "h2", "doc", "body").orderBy("pos")
    first = ranged.withColumn("first", F.row_number().over(in_doc) == 1).withColumn("part", F.spark_partition_id())
    placed = written(first, "line-ranges")
    counted = written(placed.groupBy("part", "h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("docs")), "line-counts")
    frequent = counted.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    going = counted.select("part", "h1", "h2").join(frequent.select("h1", "h2"), ["h1", "h2"], "left_semi")
    dropped = placed.join(going, ["part", "h1", "h2"], "left_semi")
    words = (
        dropped.groupBy("doc", "body", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    )
    return words.groupBy("doc", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All rows and columns of docs, the text without its dropped lines, and n_lines, n_dropped, which replace columns of those names.

    Null and empty texts are one empty line, whose key has no characters: they stay
    as they are (null stays null). Only ``\\n`` ends a line.
    """
    maps = drop_bitmaps(docs, id_col, text_col, min_docs, min_chars).select(
        F.col("doc").alias("__doc"), F.col("body").alias("__of"), F.col("drops").alias("__drops")
    )
    keyed = docs.withColumn("__body", F.xxhash64(text_of(text_col)))
    joined = keyed.join(
        maps.hint("shuffle_hash"),
        F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__body") == F.col("__of")),
        "left",
    )
    lines = F.split(F.col(text_col), "\n", -1)
    stays = lambda _, i: F.coalesce(F.col("__drops")[F.shiftright(i, 6)], F.lit(0)).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)
    ) == 0
    text = F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    n_dropped = F.coalesce(
        F.aggregate(F.map_values("__drops"), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(bits)), F.lit(0).cast("long")
    )
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(F.split(text_of(text_col), "\n", -1)).cast("long").alias("n_lines"),
        n_dropped.alias("n_dropped"),
    )


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM texts
),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AS goes FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (goes))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
