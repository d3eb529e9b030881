"""Fill-in-the-middle by escaped marker injection.

A delimiter is escaped in the text and then put after every unit; counting it numbers
the units, and ``substring_index`` cuts at any of them. What is cut is unescaped and
assembled with the three markers. DataFrame functions only, row by row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of

#: The delimiter, and what escapes it and itself. An escape is always followed by one of two letters.
MARK, ESCAPE = "\x01", "\x02"
ESCAPED_MARK, ESCAPED_ESCAPE = ESCAPE + "m", ESCAPE + "e"
#: A unit is a line with its end. Possessive, so that no character is tried twice.
UNIT = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def marked(text: Column, unit: str = UNIT) -> Column:
    """The text, escaped, with MARK after each unit; `unit` must match no empty string and leave nothing unmatched."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))
    return F.regexp_replace(escaped, f"({unit})", f"$1{MARK}")


def plain(part: Column) -> Column:
    """A part of a marked text without its marks and escapes."""
    unmarked = F.replace(F.replace(part, F.lit(MARK), F.lit("")), F.lit(ESCAPED_MARK), F.lit(MARK))
    return F.replace(unmarked, F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def pieces(text: Column, delimiter: str, count) -> Column:
    """substring_index: what stands before the count-th delimiter, or behind it from the end for a count below 0."""
    return F.call_function("substring_index", text, F.lit(delimiter), count if isinstance(count, Column) else F.lit(count))


def marks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(MARK), F.lit("")))).cast("long")


def draw(id_col: str, seed: int, k: int) -> Column:
    """The k-th group of eight digits of the sha256 of seed and id, as an unsigned integer; a null id counts as the empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT,
    seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
) -> DataFrame:
    """All rows and columns of docs, and n_units, fim_form, prefix_chars, middle_chars, fim_text.

    fim_form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``:
    a text that is null or empty, holds one of the markers, or is not drawn, stays as it is (null
    becomes empty), and its prefix_chars and middle_chars are null. Cuts fall after units, drawn by
    id and seed alone, so rows that repeat an id with the same text come out alike; a null id is
    drawn as the empty string. Columns of docs with the names of new ones are replaced. An empty
    table gives an empty one. A text of any length is cut whole.
    """
    new = ["n_units", "fim_form", "prefix_chars", "middle_chars", "fim_text"]
    kept = docs.drop(*new)
    text = F.col("__fim.text")
    work = kept.withColumn("__fim", F.struct(text_of(text_col).alias("text"), marked(text_of(text_col), unit).alias("marked")))
    work = work.withColumn("__fim", F.col("__fim").withField("n", marks(F.col("__fim.marked"))))
    n = F.col("__fim.n")
    one, two = draw(id_col, seed, 0) % (n + 1), draw(id_col, seed, 1) % (n + 1)
    holds = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains(text, F.lit(marker))
    stays = (F.octet_length(text) == 0) | holds | (draw(id_col, seed, 2) % 100 >= fim_percent)
    form = F.when(stays, "plain").when(draw(id_col, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = F.struct(
        form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"),
    )
    work = work.withColumn("__cut", cut)
    of, a, b = F.col("__fim.marked"), F.col("__cut.a"), F.col("__cut.b")
    head, through = pieces(of, MARK, a), pieces(of, MARK, b)
    # the last mark ends the text: behind it is one more, empty piece
    tail = pieces(of, MARK, -(n - b + 1).cast("int"))
    parts = F.struct(
        plain(head).alias("prefix"),
        plain(pieces(through, MARK, -(b - a))).alias("middle"),
        plain(tail).alias("suffix"),
    )
    work = work.withColumn("__part", F.when(F.col("__cut.form") != "plain", parts))
    p, s, m = (F.concat(F.lit(k), F.col(f"__part.{v}")) for k, v in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    whole = F.when(F.col("__cut.form") == "psm", F.concat(p, s, m)).when(F.col("__cut.form") == "spm", F.concat(s, p, m)).otherwise(text)
    return work.select(
        *(F.col(f"`{c}`") for c in kept.columns),
        n.alias("n_units"),
        F.col("__cut.form").alias("fim_form"),
        F.char_length("__part.prefix").cast("long").alias("prefix_chars"),
        F.char_length("__part.middle").cast("long").alias("middle_chars"),
        whole.alias("fim_text"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    between = lambda a, b: pieces(pieces(output, a, -1), b, 1)
    middle = pieces(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(docs: DataFrame) -> DataFrame:
    out = transform(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("n_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents
),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(hex, 1, 8))::BIGINT % (len(units) + 1) AS c1,
         ('0x' || substr(hex, 9, 8))::BIGINT % (len(units) + 1) AS c2, ('0x' || substr(hex, 17, 8))::BIGINT % 100 AS c3,
         ('0x' || substr(hex, 25, 8))::BIGINT % 100 AS c4
  FROM texts
),
cut AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 100 THEN 'plain'
              WHEN c4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(c1, c2)], '') AS prefix,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
