"""The test tables as ledgers: one row a transaction, signed cents, day dates.

Columns: tx_id, user_id, account_id, tx_date, merchant, app_category, amount_cents
(negative: expense), is_transfer, is_excluded, is_duplicate, is_foreign.
The same definitions stand as DuckDB SQL in ``SQL``, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flags(key: str, other: str) -> dict:
    return {
        "is_transfer": F.col(key) % 37 == 0, "is_excluded": F.col(key) % 41 == 0,
        "is_duplicate": F.col(other) % 53 == 0, "is_foreign": F.col(other) % 59 == 0,
    }


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def ledger_li(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """80 months, 20 users: order lines as spending, returned ones as income."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    lines = _lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("long")
    return lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("tx_id"),
        (F.col("o_custkey") % 20).alias("user_id"),
        F.col("o_orderpriority").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("tx_date"),
        F.col("p_name").alias("merchant"),
        F.when(F.col("l_partkey") % 23 == 0, F.lit(None)).when(F.col("l_partkey") % 29 == 0, F.lit("  ")).otherwise(F.col("p_type")).alias("app_category"),
        F.when(F.col("l_returnflag") == "R", cents).otherwise(-cents).alias("amount_cents"),
        *[c.alias(n) for n, c in _flags("l_suppkey", "l_partkey").items()], *(keep or []),
    )


#: Categories of the recurring ledger's merchants 10 to 19.
KINDS = ["Groceries", "Entertainment", "health", "LOANS", "Internet", "Phone", "Cable", "Recurring", "Rent", "Housing"]


def ledger_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring charges: 50 merchants a user, most with a fixed price."""
    fixed = (500 + 100 * (F.col("l_partkey") % 50) + F.col("l_linenumber")).cast("long")
    varied = F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    return _lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("tx_id"),
        (F.col("o_custkey") % 20).alias("user_id"),
        F.col("o_orderpriority").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("tx_date"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 50).cast("string")).alias("merchant"),
        F.when(F.col("l_partkey") % 50 < 10, F.lit("Subscriptions")).when(F.col("l_partkey") % 50 < 20, F.get(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 50 - 10).cast("int"))).alias("app_category"),
        (-F.when(F.col("l_partkey") % 5 == 0, varied).otherwise(fixed)).alias("amount_cents"),
        *[c.alias(n) for n, c in _flags("l_suppkey", "l_partkey").items()],
    )


def ledger_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month, row by row: purchases and errors cost, others pay; tx_id is unique."""
    events = table(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return events.select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id"),
        F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("account_id"),
        F.col("ts").cast("date").alias("tx_date"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("merchant"),
        F.col("event_type").alias("app_category"),
        F.when(F.col("event_type").isin("purchase", "error"), -cents).otherwise(cents).alias("amount_cents"),
        *[c.alias(n) for n, c in _flags("event_id", "event_id").items()],
    )


SQL = """
lines AS (SELECT l.*, o.o_custkey, o.o_orderpriority, o.o_orderdate FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
ledger_li AS (
  SELECT l_orderkey * 100 + l_linenumber AS tx_id, o_custkey % 20 AS user_id, o_orderpriority AS account_id,
         CAST(o_orderdate AS DATE) AS tx_date, p_name AS merchant,
         CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 29 = 0 THEN '  ' ELSE p_type END AS app_category,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS amount_cents,
         l_suppkey % 37 = 0 AS is_transfer, l_suppkey % 41 = 0 AS is_excluded, l_partkey % 53 = 0 AS is_duplicate, l_partkey % 59 = 0 AS is_foreign
  FROM lines JOIN part ON l_partkey = p_partkey
),
ledger_rec AS (
  SELECT l_orderkey * 100 + l_linenumber AS tx_id, o_custkey % 20 AS user_id, o_orderpriority AS account_id,
         CAST(o_orderdate AS DATE) AS tx_date, 'm' || CAST(l_partkey % 50 AS VARCHAR) AS merchant,
         CASE WHEN l_partkey % 50 < 10 THEN 'Subscriptions' WHEN l_partkey % 50 < 20 THEN ['Groceries', 'Entertainment', 'health', 'LOANS', 'Internet', 'Phone', 'Cable', 'Recurring', 'Rent', 'Housing'][l_partkey % 50 - 9] END AS app_category,
         -CASE WHEN l_partkey % 5 = 0 THEN CAST(floor(l_extendedprice + 0.5) AS BIGINT) ELSE 500 + 100 * (l_partkey % 50) + l_linenumber END AS amount_cents,
         l_suppkey % 37 = 0 AS is_transfer, l_suppkey % 41 = 0 AS is_excluded, l_partkey % 53 = 0 AS is_duplicate, l_partkey % 59 = 0 AS is_foreign
  FROM lines
),
ledger_ev AS (
  SELECT event_id AS tx_id, user_id, 'a' || CAST(event_id % 3 AS VARCHAR) AS account_id, CAST(ts AS DATE) AS tx_date,
         event_type || ' ' || json_extract_string(props, '$.k') AS merchant, event_type AS app_category,
         CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END * CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount_cents,
         event_id % 37 = 0 AS is_transfer, event_id % 41 = 0 AS is_excluded, event_id % 53 = 0 AS is_duplicate, event_id % 59 = 0 AS is_foreign
  FROM events
)
"""
