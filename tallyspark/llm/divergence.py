"""Divergence of sources by their terms, with counting prefiltered by a sketch.

A first pass adds up a count-min sketch of document frequencies; it never underestimates,
so a term whose least cell stays under the bound is in too few documents. A second pass
counts only what may pass, exactly, and only that is shuffled. Sources are then compared
by joins of the terms they have; terms that neither has are reckoned, not listed.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, table, text_of, written

SCALE, SMOOTH, MIN_DOCS, TOP_TERMS = 1_000_000_000, 5, 30, 50
#: Rows of the sketch.
ROWS = 3


@dataclass(frozen=True)
class Sizes:
    """How the work is dealt. Results do not depend on it: beyond most_bits a sketch only discards less.

    cell_bytes: bytes of text to a cell of a sketch's row; least_bits, most_bits: of a cell's number; block: cells of a
    row of a partial sketch; held: distinct terms that a task holds before it sends what it has counted; piece: bytes
    of a text that are split at a time.
    """

    cell_bytes: int = 128
    least_bits: int = 16
    most_bits: int = 25
    block: int = 1 << 16
    held: int = 500_000
    piece: int = 4 << 20


#: Letters, in lower case, and all bytes of other alphabets; everything else parts terms.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes, piece: int = 4 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    start = 0
    while len(text) - start > piece:
        end = start + piece
        while end < len(text) and _SPLIT[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_SPLIT).split()
        start = end
    yield text[start:].translate(_SPLIT).split()


def cells(lang: str, found: list[bytes], bits: int) -> np.ndarray:
    """(ROWS, terms) places of terms in the rows of a sketch."""
    import xxhash

    seed = xxhash.xxh32_intdigest(lang)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(t, seed) for t in found), np.uint64, len(found))
    out = np.empty((ROWS, len(found)), np.int64)
    for k in range(ROWS):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out[k] = h >> np.uint64(64 - bits)
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    """(lang, source, text in UTF-8) of a batch's rows."""
    for some in slices(batch, 2):
        yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.binary()).to_pylist(), strict=True)


def _kind(most: int):
    return np.uint8 if most < 256 else np.uint16


PARTIAL = "row int, block int, cells binary"


def _partial_sketches(bits: int, most: int, sizes: Sizes, batches):
    """A task's sketch: by row and block, counts up to `most`, compressed."""
    import zstandard

    sketch = np.zeros((ROWS, 1 << bits), _kind(most))
    found: dict[str, Counter] = defaultdict(Counter)

    def add() -> None:
        for lang, counted in found.items():
            n = np.minimum(np.fromiter(counted.values(), np.int64, len(counted)), most)
            for k, place in enumerate(cells(lang, list(counted), bits)):
                some, inverse = np.unique(place, return_inverse=True)
                sketch[k, some] = np.minimum(sketch[k, some] + np.bincount(inverse, n), most)
        found.clear()

    for batch in batches:
        for lang, _, text in _texts(batch):
            several = list(terms(text, sizes.piece))
            found[lang].update(set(several[0]).union(*several[1:]))
            if len(found[lang]) > sizes.held:
                add()
    add()
    pack = zstandard.ZstdCompressor(level=1).compress
    size = min(sizes.block, 1 << bits)
    rows = [
        (k, b, pack(part.tobytes()))
        for k in range(ROWS) for b, part in enumerate(sketch[k].reshape(-1, size)) if part.any()
    ]
    for some in itertools.batched(rows, 256):
        names = [f.split()[0] for f in PARTIAL.split(", ")]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)


def passing_cells(docs: DataFrame, min_docs: int, bits: int, sizes: Sizes = Sizes()) -> np.ndarray:
    """(ROWS, 2^bits / 8) bits: the cells of the merged sketch that reach min_docs.

    docs: (lang, source, text). Partial sketches are merged block by block, one partial at a
    time; a bit a cell comes to the driver, 12 MB at most.
    """
    import zstandard

    most = min(min_docs, 60_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, row, block = None, 0, 0
        for batch in batches:
            for row, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), _kind(most)).astype(np.int64)
                total = part if total is None else np.minimum(total + part, most)
        packed = np.packbits(total >= most).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["row", "block", "bits"])

    partial = docs.mapInArrow(lambda batches: _partial_sketches(bits, most, sizes, batches), PARTIAL)
    merged = partial.groupBy("row", "block").applyInArrow(merge, "row int, block int, bits binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    size = min(sizes.block, 1 << bits) // 8
    for r in merged.toLocalIterator():
        out[r.row, r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(passing, bits: int, sizes: Sizes, batches):
    """Exact counts of a task's terms that may pass, by lang and source."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        mask = passing.value
        for (lang, source), (n, docs) in found.items():
            names = list(n)
            stays = np.ones(len(names), bool)
            for k, place in enumerate(cells(lang, names, bits)):
                stays &= (mask[k, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            kept = [names[i] for i in np.flatnonzero(stays)]
            for some in itertools.batched(kept, 50_000):
                columns = [
                    pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in COUNTS.split(", ")])
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in _texts(batch):
            n, docs = found[lang, source]
            before = len(n)
            several = list(terms(text, sizes.piece))
            for some in several:
                n.update(some)
            docs.update(set(several[0]).union(*several[1:]))
            held += len(n) - before
            if held > sizes.held:
                yield from rows()
                held = 0
    yield from rows()


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)) of three columns, in integers of 38 digits."""
    whole = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    above = f"CAST(({whole(n)} + {SMOOTH}) * CAST({SCALE} AS DECIMAL(10, 0)) AS DECIMAL(38, 0))"
    below = f"CAST({whole(total)} + {whole(kept)} * {SMOOTH} AS DECIMAL(38, 0))"
    return F.expr(f"CASE WHEN {kept} > 0 THEN {above} div {below} + 1 END")


def term_counts(docs: DataFrame, min_docs: int, n_bytes: int, sizes: Sizes) -> DataFrame:
    """(lang, source, term, n, docs): exact counts of all terms that the sketch lets pass, among them all that reach min_docs."""
    bits = min(sizes.most_bits, max(sizes.least_bits, (n_bytes // sizes.cell_bytes).bit_length()))
    passing = docs.sparkSession.sparkContext.broadcast(passing_cells(docs, min_docs, bits, sizes))
    counted = docs.mapInArrow(lambda batches: _counted(passing, bits, sizes, batches), COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, sizes: Sizes = Sizes(),
) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each lang differ from one another and from the lang.

    A lang keeps the terms that at least min_docs of its rows hold. Part ``pair``: item is each other
    source of the lang, value the sum over all kept terms of the distance of the two shares. Part
    ``term``: item is a kept term whose share in the source is above that in the lang, value by how
    much, the first top_terms. Ranks from 1 by value, largest first, then by item in UTF-8.

    Nulls in the three columns count as empty strings, which are a lang or a source like others.
    Each row is a document, repeated ones too. A lang of one source has no pairs; one without kept
    terms has pairs of value 0 and no terms. Other columns are not read. An empty table gives no rows.
    """
    read = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    groups = written(read.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size")), "divergence-groups")
    n_bytes = groups.agg(F.sum("size")).first()[0] or 0
    counts = written(term_counts(read, min_docs, n_bytes, sizes), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = written(kept.drop("docs"), "divergence-terms")
    found = counts.drop("docs").join(kept, ["lang", "term"])
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_source = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    totals = groups.drop("size").join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").na.fill(0)
    totals = totals.withColumn("none", F.lit(0).cast("long")).withColumn("rest", share("none", "total", "kept")).drop("none")
    totals = written(totals, "divergence-totals")
    shares = found.join(totals, ["lang", "source"]).select(
        "lang", "source", "term", "rest", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")
    )
    shares = written(shares, "divergence-shares")
    place = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(place())).where(F.col("rank") <= top_terms)
    pairs = pair_distances(shares, totals).withColumn("rank", F.row_number().over(place()))
    return pairs.select(above.columns).unionByName(above)


def pair_distances(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of all ordered pairs of a lang's sources.

    With r the share of a term that a source does not have, the distance of a and b is the sum of
    |p_a - r_b| over a's terms, of |p_b - r_a| over b's, and of |r_a - r_b| over as many as are left,
    mended for the terms that both have. Only the last part is joined by term; the first ones
    need only how often a source has each share. Everything is added up before it is shuffled.
    """
    one = totals.select("lang", F.col("source").alias("a"), F.col("rest").alias("rest_a"), F.col("has").alias("has_a"), "kept")
    two = totals.select("lang", F.col("source").alias("b"), F.col("rest").alias("rest_b"), F.col("has").alias("has_b"))
    left = one.join(two, "lang").where("a < b").select(
        "lang", "a", "b", F.coalesce(F.expr("(kept - has_a - has_b) * abs(rest_a - rest_b)"), F.lit(0)).cast("long").alias("value")
    )
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    apart = often.join(two, "lang").where("source <> b").select(
        "lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), F.expr("times * abs(p - rest_b)").alias("value")
    )
    x = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("rest").alias("rest_a"))
    y = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("rest").alias("rest_b"))
    common = x.join(y, ["lang", "term"]).where("a < b").select(
        "lang", "a", "b", F.expr("abs(p_a - p_b) - abs(p_a - rest_b) - abs(p_b - rest_a) + abs(rest_a - rest_b)").alias("value")
    )
    parts = [df.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for df in (left, apart, common)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", "value", both.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
tokens AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
had AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0)::HUGEINT AS n, l.v,
         sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total,
         1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
),
p AS (SELECT lang, source, term, n, q, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v) AS p FROM full_counts),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
terms AS (
  SELECT lang, source, term AS item, p - q AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
  FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank::INTEGER FROM terms WHERE rank <= 50
"""
