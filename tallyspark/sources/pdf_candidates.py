"""Statements in PDF files: what can be told from the bytes, and the candidates that an extractor found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PAGES, SURE = 30, 0.75

# Lines that say nothing, and what dates and amounts look like.
BOILERPLATE = [
    r"page\s+\d+\s+of\s+\d+$", r"-\s*\d+\s*-$", r"\d+\s*$", r"this\s+statement\s+is\s+provided\s+", r"please\s+review\s+this\s+statement\s+",
    r"if\s+you\s+have\s+questions\s+", "member\\s+fdic", r"equal\s+housing\s+(lender|opportunity)", r"continued\s+on\s+next\s+page$",
    r"continued\s+from\s+previous\s+page$", r"\*+\s*$", r"-+\s*$", r"={3,}\s*$",
]
DATE_AT_START, A_DATE = r"^(\s*)(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})", r"\b(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2})\b"
AN_AMOUNT = r"(\$[\d,]+\.\d{2}|[\d,]+\.\d{2}\s*[CDR]?)"


def classified(files: DataFrame) -> DataFrame:
    """files (content) with is_encrypted, pages, has_text, reason (null: readable): encrypted, no text, or more than 30 pages."""
    text = F.decode("content", "ISO-8859-1")
    seen = files.withColumns({
        "is_encrypted": F.contains(text, F.lit("/Encrypt")), "pages": F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]")), "has_text": F.regexp_count(text, F.lit(r"\bBT\b")) > 0,
    })
    return seen.withColumn("reason", F.when(F.col("is_encrypted"), "encrypted").when(~F.col("has_text"), "no text").when(F.col("pages") > MOST_PAGES, "too many pages"))


def preprocessed(pages: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(by, text): pages without lines that say nothing, with dates and amounts marked, and lines that go on with a transaction joined to it.

    After the first line with a date, one without joins the line above, unless that is blank. Blank lines stand
    alone, one at a time.
    """
    lines = pages.select(*by, F.posexplode(F.split(text_col, "\n")).alias("pos", "raw")).withColumns({"line": F.regexp_replace("raw", r"\s+$", ""), "bare": F.regexp_replace("raw", r"^\s+|\s+$", "")})
    lines = lines.where(~F.col("bare").rlike(f"(?i)^({'|'.join(BOILERPLATE)})"))
    kind = F.when(F.col("bare").startswith("--- PAGE"), "page").when(F.col("bare") == "", "blank").when(F.substring("bare", 1, 12).rlike(A_DATE), "date").otherwise("other")
    order = Window.partitionBy(*by).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = lines.withColumn("kind", kind).withColumns({"last": F.lag("kind").over(order), "dated": F.coalesce(F.max(F.col("kind") == "date").over(before), F.lit(False))})
    seen = seen.where((F.col("kind") != "blank") | (F.col("last") != "blank"))
    starts = (F.col("kind") != "other") | ~F.col("dated") | F.coalesce(F.col("last") == "blank", F.lit(True)) | F.col("bare").startswith("---")
    marked = F.regexp_replace(F.regexp_replace("line", DATE_AT_START, "[DATE]$1$2"), AN_AMOUNT, "[AMT:$1]")
    shown = F.when(~F.col("starts"), F.col("bare")).when(F.col("kind").isin("page", "blank"), F.col("line")).otherwise(marked)
    grouped = seen.withColumn("starts", starts).withColumn("at", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(c, "shown"))), lambda x: x["shown"])
    joined = grouped.withColumn("shown", shown).groupBy(*by, "at").agg(F.array_join(ordered("pos"), " ").alias("shown"))
    return joined.groupBy(*by).agg(F.regexp_replace(F.array_join(ordered("at"), "\n"), r"^\s+|\s+$", "").alias("text"))


def validated(candidates: DataFrame) -> DataFrame:
    """candidates (date, description, amount_cents, direction, confidence) with combined: the mean of their own confidence, between 0 and 1, and the share of
    four things that are there: a date, a description, an amount and a direction."""
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    flags = [F.col("date").isNotNull(), F.length(F.trim(F.coalesce("description", F.lit("")))) > 0, F.col("amount_cents").isNotNull() & (F.col("amount_cents") != 0), F.coalesce(F.col("direction").isin("debit", "credit"), F.lit(False))]
    share = sum((F.when(x, 1).otherwise(0) for x in flags), F.lit(0)) / 4
    return candidates.withColumns({"confidence": own, "combined": (own + share) / 2})


def deduplicated(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of a file's candidates with one date, amount and description the surest, the first of equals."""
    key = [*by, "date", "amount_cents", "description"]
    order = Window.partitionBy(*key).orderBy(F.desc("combined"), "position")
    return candidates.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def issues(candidates: DataFrame, by: list[str], first: Column, last: Column) -> DataFrame:
    """(by, position, issue) of candidates: more than seven days outside the statement, above a million, repeated, unsure, or with neither a date nor an amount."""
    same = F.count("*").over(Window.partitionBy(*by, "date", "amount_cents", "description"))
    found = candidates.withColumn("__same", same).select(*by, "position", F.explode(F.array_compact(F.array(
        F.when((F.col("date") < F.date_sub(first, 7)) | (F.col("date") > F.date_add(last, 7)), "DATE_OUT_OF_RANGE"), F.when(F.abs("amount_cents") > 100_000_000, "AMOUNT_SUSPICIOUS"),
        F.when(F.col("__same") > 1, "DUPLICATE_CANDIDATE"), F.when(F.col("combined") < SURE, "LOW_CONFIDENCE"), F.when(F.col("date").isNull() & F.col("amount_cents").isNull(), "INCOMPLETE"),
    ))).alias("issue"))
    return found


def ledger_rows(candidates: DataFrame) -> DataFrame:
    """Candidates sure enough, with the sign of their direction."""
    size = F.abs("amount_cents")
    return candidates.where(F.col("combined") >= SURE).withColumn("amount_cents", F.when(F.col("direction") == "debit", -size).when(F.col("direction") == "credit", size).otherwise(F.col("amount_cents")))
