"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Samples are banded; texts that share a band's key are compared by weighted Jaccard
similarity. A bucket is joined to its most central text, never pair by pair; what that
leaves in different classes is joined by the rarest shingles.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import components, slices, text_of, written

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**14, 0.99996.
BANDS, ROWS = 14, 3
#: Document frequencies are kept for so many classes of shingles by hash, whatever the size of the corpus.
CLASS_BITS = 18
#: Buckets of at most so many texts are compared pair by pair, at most 28 pairs.
SMALL = 8
#: Larger buckets are compared to so many heads, round by round. If that leaves several classes in one, all its texts are
#: compared across the classes by shared rare shingles.
HEADS = 1, 4
#: So many shingles in front of a shared one tell whether it is the first; more would only make fewer pairs twice.
BEFORE = 8
#: A shingle's holders are paired in cells of about so many by so many.
CELL = 64
REMEMBERED = 500_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def shingles(words: _Words, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, how often): runs of five words in lower case. A shorter text is one shingle; without words, none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - WORDS + 1)
    out = h[:n].copy()
    for j in range(1, min(WORDS, len(h))):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return np.unique(out, return_counts=True)


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The weight of each class of shingles: 1 + ln(texts / texts with it) / ln(classes), from all texts.

    It lies between 1 and 2, so a shingle that a large group of copies shares does not
    weigh next to nothing beside one copy's edits. Each task adds up all of its texts.
    """

    def run(batches):
        words, total, texts = _Words(), np.zeros(1 << CLASS_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    h, _ = shingles(words, text)
                    total[np.unique(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)] += 1
                    texts += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], texts))], ["class", "texts"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "class long, texts long")
    # at most 2**CLASS_BITS + 1 rows, as columns: rows would be some 100 MB of Python's objects on the driver
    found = counted.groupBy("class").agg(F.sum("texts").alias("texts")).toArrow().to_pandas()
    texts = max(1, int(found.loc[found["class"] < 0, "texts"].sum()))
    found = found[found["class"] >= 0]
    frequency = np.ones(1 << CLASS_BITS)
    frequency[found["class"]] = found["texts"]
    return (1 + np.log(texts / np.minimum(texts, frequency)) / np.log(1 << CLASS_BITS)).astype(np.float32)


def weighted(words: _Words, inverse: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    h, times = shingles(words, text)
    return h, times * inverse[(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)].astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of minima by that of maxima; 0 if there is nothing."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


@cache
def _samplers():
    """Multipliers that give each sample's random bits of a shingle, and the quantiles of gamma(2, 1)."""
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    level = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(1 << 16, 1.5)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < level
        low, high = np.where(below, x, low), np.where(below, high, x)
    return a, b, x.astype(np.float32), np.log(x).astype(np.float32)


def band_keys(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A key for each band: improved consistent weighted sampling takes, for each sample, the shingle with
    the smallest ln c - r (t - beta + 1), where t = floor(ln weight / r + beta)."""
    a, b, gamma, log_gamma = _samplers()
    best, chosen, step = np.full(len(a), np.inf, np.float32), np.zeros(len(a), np.uint64), np.zeros(len(a), np.int64)
    log_w = np.log(weight).astype(np.float32)
    mask = np.uint64(0xFFFF)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024]
        x = part[:, None] * a + b
        r = gamma[x >> np.uint64(48)]
        beta = ((x >> np.uint64(16)) & mask).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w[at : at + 1024, None] / r + beta)
        value = log_gamma[(x >> np.uint64(32)) & mask] - r * (t - beta + 1)
        k = value.argmin(0)
        columns = np.arange(len(a))
        now = value[k, columns]
        better = now < best
        best[better], chosen[better], step[better] = now[better], part[k][better], t[k, columns][better]
    key = chosen * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))).reshape(BANDS, ROWS)
    mixed = key[:, 0].copy()
    for j in range(1, ROWS):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + key[:, j]
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, inverse: np.ndarray) -> DataFrame:
    """pairs (a, b) with sim: each text is fetched by a join, and compared where the pair is."""
    # pairs and texts both grow with the corpus: the joins shuffle at every size
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        words, last, held = _Words(), None, None
        for batch in batches:
            sims = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):  # never all texts as strings
                if b != last:  # a head's pairs mostly come one after another
                    last, held = b, weighted(words, inverse, text_b.as_py())
                sims.append(similarity(weighted(words, inverse, text_a.as_py()), held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return both.mapInArrow(run, "a binary, b binary, sim double")


def _more(tried: DataFrame | None, asked: DataFrame, texts: DataFrame, inverse: np.ndarray) -> DataFrame:
    asked = asked.distinct()
    if tried is not None:
        asked = asked.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    checked = written(_verified(asked, texts, inverse), "near-checked")
    return checked if tried is None else tried.unionByName(checked)


def _prefix_pairs(waiting: DataFrame, texts: DataFrame, inverse: np.ndarray, threshold: float) -> DataFrame:
    """(a, b) of all nodes that wait, are of different classes and can be similar: exact prefix filtering.

    A node is of its `class`; without that column, each is one. Shingles are taken rarest
    class first, until those left weigh less than the threshold's share of the text.
    Texts without a common one among them are less similar than the threshold, and so
    are texts one of which weighs so much less. A pair is made at its first common
    shingle, where what either text has from there on bounds all they share; a pair that
    shares one of the BEFORE shingles in front has been made there.

    The holders of a shingle that are not of its largest class are joined to all of its
    holders, so a large class is never paired with itself. Both sides are dealt to cells;
    of a shingle with more holders than a cell's, only to those of weights that can match.
    """

    def run(batches):
        words = _Words()
        for batch in batches:
            at, tokens, whole, rest, before = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                h, weight = weighted(words, inverse, text)
                order = np.lexsort((h, -inverse[(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]))
                left = weight.sum() - np.cumsum(weight[order])
                n = np.searchsorted(-left, -threshold * weight.sum(), "right") + 1
                tokens.append(h[order[:n]].view(np.int64))
                at += [row] * len(tokens[-1])
                whole.append(np.full(len(tokens[-1]), weight.sum()))
                rest.append((left + weight[order])[: len(tokens[-1])])
                before += [tokens[-1][max(0, i - BEFORE) : i] for i in range(len(tokens[-1]))]
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(2)] + [
                pa.array(np.concatenate(x) if x else [], t) for x, t in ((tokens, pa.int64()), (whole, pa.float64()), (rest, pa.float64()))
            ]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.list_(pa.int64()))], ["node", "class", "token", "whole", "rest", "before"])

    own = F.col("class") if "class" in waiting.columns else F.col("node").alias("class")
    nodes = written(waiting.select("node", own).distinct(), "near-rest")
    held = texts.select("node", "text").join(nodes.hint("merge"), "node").select("node", "class", "text")
    found = written(held.mapInArrow(run, "node binary, class binary, token long, whole double, rest double, before array<long>"), "near-prefixes")
    counted = found.groupBy("token", "class").agg(F.count("*").alias("n")).groupBy("token")
    counted = counted.agg(F.max(F.struct("n", "class")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    shared = found.join(counted.select("token", F.col("n").alias("all"), F.col("most.class").alias("largest")), "token")
    # texts whose weights differ by the threshold's factor at most are of one span or of neighbours
    span = F.when(F.col("all") > CELL, F.floor(F.log("whole") / (1e-6 - math.log(threshold)))).otherwise(0)
    shared = shared.withColumns({"major": F.col("class") == F.col("largest"), "span": span})
    minor, whole = shared.where("not major"), shared
    near = F.when(F.col("all") > CELL, F.array(*(F.col("span") + i for i in (-1, 0, 1)))).otherwise(F.array(F.col("span")))
    minor = minor.withColumn("span", F.explode(near))
    sizes = [rows.groupBy("token", "span").agg(F.ceil(F.count("*") / CELL).alias(f"of_{n}")) for n, rows in (("a", minor), ("b", whole))]
    sizes = written(sizes[0].join(sizes[1], ["token", "span"]), "near-spans")
    near_size = F.least("whole_a", "whole_b") >= F.greatest("whole_a", "whole_b") * (threshold * (1 - 1e-9))
    enough = F.least("rest_a", "rest_b") >= (F.col("whole_a") + F.col("whole_b")) * (threshold / (1 + threshold) * (1 - 1e-9))
    first = ~F.arrays_overlap("before_a", "before_b")
    sides = []
    for n, rows, mine, other in (("a", minor, "of_a", "of_b"), ("b", whole, "of_b", "of_a")):
        # each holder is in one row of cells, or column, and in all of its cells
        cell = F.pmod(F.xxhash64(F.lit(n), "node"), F.col(mine)).alias(f"at_{n}")
        all_cells = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("at_b" if n == "a" else "at_a")
        sides.append(rows.join(sizes, ["token", "span"]).select("token", "span", cell, all_cells, F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("class", "major", "whole", "rest", "before"))))
    pairs = sides[0].join(sides[1], ["token", "span", "at_a", "at_b"]).where("class_a <> class_b and (major_b or a < b)").where(near_size & enough & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(docs: DataFrame, text_col: str = "text", threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(node of each row of docs, links between nodes). A node is a text, by its digest.

    The rows are docs and node. links: a, b, between different texts; they connect what all
    pairs of similarity >= threshold in a bucket connect.
    """
    noded = docs.withColumn("__node", F.unhex(F.md5(text_of(text_col))))
    inverse = inverse_frequencies(docs, text_col)

    def run(batches):
        words = _Words()
        for batch in batches:
            for part in slices(batch, 1):
                keys = []
                for text in part.column(1).to_pylist():
                    h, w = weighted(words, inverse, text)
                    keys.append(band_keys(h, w) if len(h) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    sampled = noded.select(F.col("__node").alias("node"), text_of(text_col).alias("text")).mapInArrow(run, "node binary, keys array<long>")
    entries = written(sampled.select("node", F.posexplode("keys").alias("band", "key")).distinct(), "near-entries")
    sizes = written(entries.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1"), "near-sizes")
    members = entries.join(sizes, ["band", "key"])
    central = members.groupBy("node").agg(F.sum("m").alias("central"))
    members = written(members.join(central, "node"), "near-members")
    needed = written(central.select("node"), "near-nodes")
    texts = noded.select(F.col("__node").alias("node"), text_of(text_col).alias("text")).join(needed.hint("merge"), "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    small = members.where(F.col("m") <= SMALL).select("band", "key", "node")
    pairs = small.withColumnRenamed("node", "a").join(small.withColumnRenamed("node", "b"), ["band", "key"]).where("a < b").select("a", "b")
    large = members.where(F.col("m") > SMALL).select("band", "key", "node", "central")
    waiting, tried = large, None
    for heads_each in HEADS:
        # a head from each part of a bucket by hash; every other member that waits is compared to all of them
        part = F.pmod(F.xxhash64(F.lit(heads_each), "node"), F.lit(heads_each))
        heads = waiting.groupBy("band", "key", part.alias("part")).agg(F.max(F.struct("central", "node")).alias("h"))
        heads = written(heads.select("band", "key", F.col("h.node").alias("head")), "near-heads")
        starred = written(waiting.join(heads, ["band", "key"]).where("node <> head"), "near-star")
        asked = starred.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
        tried = _more(tried, asked.union(pairs) if tried is None else asked, texts, inverse)
        # those wait on that no head matched and that were no head
        matched = tried.where(F.col("sim") >= threshold).select("a", "b", F.lit(1).alias("hit"))
        near = starred.withColumns({"a": F.least("node", "head"), "b": F.greatest("node", "head")}).join(matched, ["a", "b"], "left")
        unmatched = near.groupBy("band", "key", "node", "central").agg(F.count("hit").alias("hits")).where("hits = 0").drop("hits")
        waiting = written(unmatched.join(heads.withColumnRenamed("head", "node"), ["band", "key", "node"], "left_anti"), "near-waiting")
        if waiting.isEmpty():
            break
    links = tried.where(F.col("sim") >= threshold).select("a", "b")
    if heads_each == HEADS[0]:
        return noded, links  # no bucket has two classes
    # a head's own are one class, but texts of different heads, or of none, can be similar as well
    classes = written(components(links), "near-classes")
    large = large.join(classes, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("class"))
    several = large.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    rest = large.join(several.select("band", "key"), ["band", "key"], "left_semi").select("node", "class")
    more = written(_verified(_prefix_pairs(rest, texts, inverse, threshold), texts, inverse), "near-checked")
    return noded, classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.where(F.col("sim") >= threshold).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """All rows and columns of docs, and component_id, group_size long, kept boolean.

    Classes are what links of weighted Jaccard similarity >= threshold, and equal
    texts, connect. component_id is the smallest id of a class, and its row is kept; rows
    that repeat that id with a text of the class are kept with it. Texts without words
    are like none but their equals. Null counts as the empty text. A null id is no
    class's smallest while there are others; if all are null, all are kept.
    """
    noded, links = near_links(docs, text_col, threshold)
    classes = components(links).select("node", F.col("component").alias("root"))
    rows = noded.select(F.col(id_col).alias("id"), F.col("__node").alias("node"))
    rooted = rows.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("group_size"))
    found = rooted.select("node", "root").distinct().join(groups, "root").select(F.col("node").alias("__of"), "component_id", "group_size")
    kept = noded.drop("component_id", "group_size", "kept").join(found.hint("shuffle_hash"), F.col("__node") == F.col("__of"))
    return kept.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).drop("__node", "__of")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "component_id", "group_size", "kept")
