"""Temperature mixing of sources, realised as budgeted permutations of blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of, written

#: Tokens of a block, and most blocks of a source: larger sources get larger blocks.
BLOCK_TOKENS, MAX_BLOCKS = 4096, 65536


def tokens(text_col: str = "text"):
    """Runs of characters other than white space."""
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def body(text_col: str):
    """128 bits that, with the id, tell a row's text from others."""
    return F.unhex(F.md5(text_of(text_col)))


@dataclass
class Mixture:
    exponent: float
    budget: float
    #: Natural logarithms: of the sum of powered shares, and the entropy of the weights.
    log_z: float
    entropy: float


def _measure(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(log z, entropy, log of the largest weight to share ratio relative to the largest source) for each exponent.

    One aggregation for all exponents, whatever the number of sources. Shares are
    taken relative to the largest, so no power underflows for it.
    """
    aggregates = []
    for i, a in enumerate(exponents):
        powered = F.exp(F.lit(a) * F.col("log_rel"))
        aggregates += [F.sum(powered).alias(f"z{i}"), F.sum(powered * F.col("log_rel")).alias(f"d{i}")]
    row = shares.agg(F.min("log_rel").alias("low"), *aggregates).first()
    import math

    out = []
    for i, a in enumerate(exponents):
        z, d = row[f"z{i}"], row[f"d{i}"]
        out.append((math.log(z), math.log(z) - a * d / z, (a - 1) * row.low))
    return out


def fit(shares: DataFrame, total: float, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> Mixture:
    """The exponent in [0, 1]: the entropy's share of its maximum is target_entropy, or else the
    flattest for which no source is repeated more than max_repeats times.

    budget None: as many tokens as show every source at least once. Both measures fall
    as the exponent grows; each round narrows the interval by its 33 points.
    """
    import math

    low, high = 0.0, 1.0
    largest = _measure(shares, [0.0])[0][1]

    def fits(exponent: float, log_z: float, entropy: float, log_ratio: float) -> bool:
        if target_entropy is not None:
            return entropy <= target_entropy * largest + 1e-12
        if budget is None:
            return log_ratio <= math.log(max_repeats) + 1e-12
        top = shares_top(shares)
        return budget / total * math.exp(log_ratio - log_z) / top <= max_repeats * (1 + 1e-12)

    for _ in range(9):
        points = [low + (high - low) * k / 32 for k in range(33)]
        good = [fits(p, *m) for p, m in zip(points, _measure(shares, points), strict=True)]
        first = next((k for k, g in enumerate(good) if g), 32)
        low, high = points[max(0, first - 1)], points[first]
        if first == 0 or high - low < 1e-12:
            break
    log_z, entropy, _ = _measure(shares, [high])[0]
    if budget is not None:
        budget = max(0.0, budget)
    else:
        # the source shown least is the largest one: it is shown once
        budget = total * shares_top(shares) * math.exp(log_z)
    return Mixture(high, float(budget), log_z, entropy)


def shares_top(shares: DataFrame) -> float:
    return shares.agg(F.max("share")).first()[0]


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """Rows (id, body, source, n_tokens, weight, repeats, epoch, block, block_rank): one for each time
    that a row of docs is shown.

    weight: the source's share of the mixture, share ** exponent, normalised.
    repeats: budget * weight / the source's tokens. Its whole part are whole epochs;
    of the rest, blocks are shown in that epoch's permutation while they fit the
    budget. block_rank: the block's place in its epoch's permutation.

    A null source is a source. A source without tokens costs nothing and is shown
    once. Rows with equal id and text are shown together. No tokens at all, or an
    empty table: every row once. A budget of 0 or less, or below any block, shows
    nothing of the sources with tokens.

    The permutation of an epoch is one window of a source's blocks, at most MAX_BLOCKS
    rows, whatever the number of its documents.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), body(text_col).alias("body"), F.col(source_col).alias("source"),
        tokens(text_col).alias("n_tokens"),
    )
    rows = written(rows, "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    totals = sources.agg(F.sum("source_tokens").alias("all"), F.max("source_tokens").alias("top")).first()
    total, top = totals["all"] or 0, totals["top"] or 0
    if not total:
        sources = sources.select("source", F.lit(0).cast("long").alias("source_tokens"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"))
    else:
        shares = written(
            sources.where("source_tokens > 0").select(
                "source", (F.col("source_tokens") / F.lit(total)).alias("share"), F.log(F.col("source_tokens") / F.lit(top)).alias("log_rel")
            ),
            "mix-shares",
        )
        found = fit(shares, total, target_entropy, max_repeats, budget)
        rel = F.log(F.col("source_tokens") / F.lit(top))
        weight = F.when(F.col("source_tokens") > 0, F.exp(F.lit(found.exponent) * rel - F.lit(found.log_z))).otherwise(0.0)
        sources = sources.withColumn("weight", weight).withColumn(
            # an epoch that is missed by rounding alone is whole
            "repeats",
            F.when(F.col("source_tokens") > 0, F.round(F.lit(found.budget) * F.col("weight") / F.col("source_tokens"), 9)).otherwise(1.0),
        )
    sources = sources.withColumn(
        "blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / F.lit(BLOCK_TOKENS)))).cast("int")
    )
    sources = written(sources, "mix-sources").withColumnRenamed("source", "s")
    in_block = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "id", "body"), F.col("blocks")).cast("int")
    )
    in_block = written(in_block, "mix-blocks")
    blocks = in_block.groupBy("source", "block", "source_tokens", "repeats").agg(F.sum("n_tokens").alias("block_tokens"))
    epochs = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    shown = blocks.withColumn("epoch", F.explode(epochs))
    order = [F.xxhash64(F.lit(seed), F.lit("order"), "source", "epoch", "block"), F.col("block")]
    permuted = Window.partitionBy("source", "epoch").orderBy(*order)
    shown = shown.withColumn("block_rank", F.row_number().over(permuted)).withColumn(
        "spent", F.sum("block_tokens").over(permuted.rowsBetween(Window.unboundedPreceding, 0))
    )
    last = F.col("repeats") - F.col("epoch")
    shown = shown.where((last >= 1) | (F.col("spent") <= last * F.col("source_tokens")))
    shown = shown.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "block_rank")
    return in_block.join(shown, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select(
        "id", "body", "source", "n_tokens", "weight", "repeats", "epoch", "block", "block_rank"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with each row as often as its plan shows it; the columns of docs. See plan."""
    shown = plan(docs, id_col, text_col, source_col, **how)
    times = shown.groupBy(F.col("id").alias("__id"), F.col("body").alias("__b"), F.col("source").alias("__s")).agg(
        F.countDistinct("epoch").cast("int").alias("__times")
    )
    keyed = docs.withColumn("__body", body(text_col))
    joined = keyed.join(
        times.hint("shuffle_hash"),
        F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__b")) & F.col(source_col).eqNullSafe(F.col("__s")),
    )
    return joined.select(*[keyed[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__time")).drop("__time")


def query(docs: DataFrame) -> DataFrame:
    return plan(docs.select("doc_id", "text", "source")).select(
        F.col("id").alias("doc_id"), "source", "n_tokens", "weight", "repeats", "epoch", "block", "block_rank"
    )
