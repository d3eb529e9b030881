"""Near-duplicate vectors by spherical-cap filters.

Filter directions are products of random codewords, one for each block of
coordinates. A vector is list-decoded to all filters whose direction it exceeds the
threshold for; vectors of a filter are compared in blocks.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import components, written

SIMILARITY = 0.98
#: Blocks of coordinates; filters that a vector passes on average, and at least; vectors in a filter on average.
BLOCKS, PASSED, LEAST, CROWD = 4, 20, 12, 48
#: Vectors compared at a time. A fuller filter is cut into pairs of such blocks.
BLOCK_ROWS = 512
#: The code's threshold is measured with so many random directions and filters, whatever the number of filters.
PROBES, DRAWN = 512, 1 << 14


@dataclass
class Code:
    """codewords: for each block, (words, width) unit rows. threshold: on the scaled sum over blocks."""

    codewords: list[np.ndarray]
    edges: list[int]
    threshold: float

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit row of x, the numbers of all filters it passes.

        A row that passes fewer than LEAST gets a lower threshold of its own, step by
        step. A near row's scores differ little, so it passes nearly the same ones.

        Sums over the first half of the blocks, in falling order, are met with those of
        the second half that still reach the threshold: the work follows what is found.
        """
        scores = [x[:, a:b] @ c.T for a, b, c in zip(self.edges, self.edges[1:], self.codewords, strict=False)]
        half = len(scores) // 2
        left, right = _sums(scores[:half]), _sums(scores[half:])
        out = []
        for u, v in zip(left, right, strict=True):
            order = np.argsort(-v, kind="stable")
            falling = v[order]
            threshold = self.threshold
            while (n := np.searchsorted(-falling, u - threshold, "right")).sum() < min(LEAST, len(u) * len(v)):
                threshold -= 0.02
            some = np.flatnonzero(n)
            at = np.repeat(some, n[some])
            within = np.arange(len(at)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            out.append(np.sort(at * len(v) + order[within]))
        return out


def _sums(scores: list[np.ndarray]) -> np.ndarray:
    total = scores[0]
    for s in scores[1:]:
        total = (total[:, :, None] + s[:, None, :]).reshape(len(total), -1)
    return total


def make_code(width: int, rows: int, seed: int = 5) -> Code:
    """Filters grow with the rows, so that a filter's crowd does not."""
    blocks = max(1, min(BLOCKS, width))
    filters = max(256, rows * PASSED / CROWD)
    words = max(2, math.ceil(filters ** (1 / blocks)))
    edges = np.linspace(0, width, blocks + 1).astype(int).tolist()
    rng = np.random.default_rng(seed)
    codewords = []
    for a, b in zip(edges, edges[1:], strict=False):
        c = rng.standard_normal((words, b - a))
        codewords.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / width))
    # the threshold that random directions exceed for the wanted share of filters, from some filters drawn at random
    x = rng.standard_normal((PROBES, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    drawn = sum(x[:, a:b] @ c[rng.integers(0, words, DRAWN)].T for a, b, c in zip(edges, edges[1:], codewords, strict=False))
    return Code(codewords, edges, float(np.quantile(drawn, 1 - min(1.0, PASSED / words**blocks))))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit rows; the largest component goes first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _met_before(a: np.ndarray, b: np.ndarray, filters: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each pair (a, b) of n rows, whether one of the filters (each with its row) is of both."""
    out = np.zeros(len(a), bool)
    found, place = np.unique(filters, return_inverse=True)
    if not len(found):
        return out
    held = np.zeros((n, len(found)), bool)
    held[rows, place] = True
    bits = np.packbits(held, axis=1)
    step = max(1, (32 << 20) // bits.shape[1])
    for at in range(0, len(a), step):
        out[at : at + step] = (bits[a[at : at + step]] & bits[b[at : at + step]]).any(1)
    return out


def _unit(vectors) -> np.ndarray:
    return _scaled(np.stack([np.asarray(v, np.float64) for v in vectors]))


def vector_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = SIMILARITY
) -> DataFrame:
    """All rows of vectors as id, node and n_links, component: see near_vectors."""
    usable = F.expr(
        f"`{vector_col}` IS NOT NULL AND size(`{vector_col}`) > 0 AND NOT exists(`{vector_col}`, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
        f" AND exists(`{vector_col}`, v -> v <> 0)"
    )
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), label.alias("label"), usable.alias("usable"))
    rows = rows.withColumn("usable", F.coalesce("usable", F.lit(False)) & F.col("label").isNotNull())
    # equal vectors of a label are one node; -0.0 and 0.0 are told apart, which costs only work
    rows = rows.withColumn("node", F.when(F.col("usable"), F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("string"))))))
    rows = written(rows, "vec-rows")
    nodes = rows.where("usable").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"))
    nodes = written(nodes, "vec-nodes")
    width = nodes.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    code = make_code(width, max(r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1).collect()))

    def decode(batches):
        for batch in batches:
            if not len(batch):
                continue
            padded = [np.pad(np.asarray(v, np.float64), (0, width - len(v))) for v in batch["v"]]
            batch["filters"] = [f.astype(np.int64) for f in code.decode(_unit(padded))]
            yield batch[["node", "label", "v", "copies", "filters"]]

    kind = nodes.schema["v"].dataType.simpleString()
    fields = f"node binary, label {nodes.schema['label'].dataType.simpleString()}, v {kind}, copies long, filters array<long>"
    passed = written(nodes.select("node", "label", "v", "copies").mapInPandas(decode, fields), "vec-passed")

    # a filter of more than BLOCK_ROWS is cut into blocks; each pair of blocks is a task's group
    entries = passed.select("label", F.explode("filters").alias("filter"), "node")
    crowds = entries.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
    )
    crowds = written(crowds, "vec-crowds")
    placed = passed.withColumn("filter", F.explode("filters")).join(crowds.drop("n"), ["label", "filter"])
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})

    def compare(number, x, filters, holders, mine, copies, across):
        """(links of each row, for each row one of its class): the links of one group that belong to its filter.
        filters and holders: the filters of the rows, and the row of each."""
        near = x @ x.T >= threshold - 1e-9
        if across:
            near &= np.not_equal.outer(mine, mine)
        a, b = np.nonzero(np.triu(near, 1))
        good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        a, b = a[good], b[good]
        # a link belongs to the first filter that both pass
        lower = filters < number
        new = ~_met_before(a, b, filters[lower], holders[lower], len(x))
        a, b = a[new], b[new]
        links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        root = list(range(len(x)))  # of the group's links, a forest is enough for the classes

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        return links.astype(np.int64), np.array([find(i) for i in range(len(x))])

    def run(batches):
        """Groups lie one after another; the last of a batch waits for the next batch."""
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not len(held):
                continue
            held = held.combine_chunks()
            keys = np.stack([held[c].to_numpy().astype(np.int64) for c in ("group", "filter", "low", "high")], axis=1)
            cuts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            if batch is None:
                cuts = np.append(cuts, len(held))
            whole = held.slice(0, cuts[-1])
            if len(whole):
                yield compared(whole, keys, cuts)
            held = held.slice(cuts[-1])

    def compared(rows, keys, cuts):
        v, lists = rows["v"].combine_chunks(), rows["filters"].combine_chunks()
        x = np.zeros((len(rows), width))
        sizes, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy().astype(np.float64)
        x[np.arange(width)[None, :] < sizes[:, None]] = flat
        x = _scaled(x)
        many = lists.value_lengths().to_numpy()
        numbers, starts, owner = lists.flatten().to_numpy(), np.append(0, np.cumsum(many)), np.repeat(np.arange(len(rows)), many)
        copies, mine = rows["copies"].to_numpy(), rows["mine"].to_numpy()
        links, to = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s > 1:
                of = slice(starts[s], starts[e])
                links[s:e], root = compare(keys[s, 1], x[s:e], numbers[of], owner[of] - s, mine[s:e], copies[s:e], keys[s, 2] != keys[s, 3])
                to[s:e] = s + root
        some = np.flatnonzero(links)
        node = rows["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(some)), node.take(pa.array(to[some])), pa.array(links[some])], ["node", "to", "links"])

    placed = placed.select(
        F.xxhash64("label").alias("group"), "filter", "low", "high", "node", F.col("v").cast("array<double>" if "double" in kind else "array<float>").alias("v"),
        "copies", "filters", "mine",
    )
    grouped = placed.repartition("group", "filter", "low", "high").sortWithinPartitions("group", "filter", "low", "high")
    found = grouped.mapInArrow(run, "node binary, to binary, links long")
    found = written(found, "vec-links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    rooted = nodes.select("node", "copies").join(degree, "node", "left").join(classes, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")
    )
    rooted = written(rooted, "vec-rooted")
    smallest = rows.where("usable").groupBy("node").agg(F.min("id").alias("low")).join(rooted, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    answer = rooted.join(smallest, "root").select("node", "n_links", "component_id")
    return rows.select("id", "node").join(answer, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = SIMILARITY
) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept.

    Vectors with equal labels link at a cosine, in double precision, of at least the
    threshold. Null labels, null, empty or zero vectors, and those with a null or
    non-finite component link with nothing: n_links 0, component_id their own id.
    Shorter vectors count as filled up with zeros. Equal vectors are compared once;
    each counts. n_links: other rows linked directly. component_id: the smallest id
    that links reach. Repeated ids are rows like others.
    """
    out = vector_links(vectors, id_col, vector_col, label_col, threshold)
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def query(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings.select("vec_id", "embedding", "label"))
