"""Running values and places within keys whose rows are too many for one task.

A key's rows are cut into spans that follow one another. Each span is worked by itself; what a span hands
on to the next ones is one small row, and those rows alone are gathered by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import written


def _same(left: DataFrame, right: DataFrame, keys: list[str], names: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[names[k]]) for k in keys))


def span_of(rows: DataFrame, order: list[str], grain: str = "month") -> Column:
    """Spans by calendar, for rows whose first order column is a date; one span for others."""
    return F.trunc(order[0], grain) if rows.schema[order[0]].dataType.simpleString() == "date" else F.lit(None).cast("date")


def last_before(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], span: Column) -> DataFrame:
    """rows and, for each name of values, the last value that is not null before the row among those of its key; null if there is none.

    order: columns, rising, nulls first. span: rises with the order (not strictly), so that a span's rows stand together.
    """
    spanned = rows.withColumns({"__span": span, **{f"__own_{n}": c for n, c in values.items()}})
    keys = [*by, "__span"]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = spanned.withColumns({n: F.last(f"__own_{n}", ignorenulls=True).over(before) for n in values})
    ends = spanned.groupBy(*keys).agg(*(
        F.max(F.when(F.col(f"__own_{n}").isNotNull(), F.struct(*order, F.col(f"__own_{n}").alias("__value"))))["__value"].alias(f"__end_{n}") for n in values
    ))
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    carried = ends.select(*(F.col(k).alias(v) for k, v in names.items()), *(F.last(f"__end_{n}", ignorenulls=True).over(earlier).alias(f"__carried_{n}") for n in values))
    joined = inside.join(carried, _same(inside, carried, keys, names), "left")
    return joined.select(*(F.col(c) for c in rows.columns if c not in values), *(F.coalesce(n, f"__carried_{n}").alias(n) for n in values))


def placed(rows: DataFrame, by: list[str], order: list[Column], place: str = "place", columns: list[str] | None = None) -> DataFrame:
    """rows with their place from 1 in the order among those of their key; equal rows follow one another in any order.
    columns: those of rows that are returned, by among them; what only the order needs is not written.

    The rows are cut into ranges by key and order, sorted, and written once: a range's rows are numbered as they stand. A
    key's place is that number and the rows of it in the ranges before; only counts by range and key are gathered.
    """
    ends = [*(F.col(k).asc() for k in by), *order]
    at = F.monotonically_increasing_id()
    columns = [c for c in (columns or rows.columns) if c != place]
    kept = written(rows.repartitionByRange(*ends).sortWithinPartitions(*ends).select(*columns, at.alias("__at")).withColumn("__range", F.shiftright("__at", 33)), "placed")
    keys = [*by, "__range"]
    counts = kept.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    offsets = counts.select(*(F.col(k).alias(v) for k, v in names.items()), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__offset"))
    joined = kept.join(offsets, _same(kept, offsets, keys, names))
    return joined.select(*columns, (F.col("__at") + F.col("__offset")).alias(place))
