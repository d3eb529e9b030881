"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features learns one lookup table a
feature, and one a chosen pair of features. A score is a sum of table entries,
added for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, text_of

#: Most labelled rows that the driver fits on; the smallest hashes of their ids are taken.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, RIDGE = 150, 0.1, 5.0

FEATURES = [
    "log_bytes", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "bar", "other_ascii", "high_bytes",
    "word_length", "unique_words", "top_word", "unique_lines", "line_bytes", "marked_words", "upper_words",
]
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _SYMBOL, _BAR, _OTHER, _HIGH = range(11)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for chars, k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT),
                     (b" \t\x0b\x0c\r", _SPACE), (b"\n", _LINE), (b".,;:", _STOP), (b"!?", _MARK), (b"#$%&*+=<>@^_~{}[]\\", _SYMBOL), (b"|", _BAR)):
        kind[list(chars)] = k
    kind[128:] = _HIGH
    return kind


_KIND = _classes()


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text, of shares and counts over the whole text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        counts = np.bincount(_KIND[raw], minlength=11)
        n = len(raw)
        letters = max(1, counts[_UPPER] + counts[_LOWER])
        row[0] = np.log1p(n)
        row[1] = counts[_UPPER] / letters
        row[2:11] = counts[[_DIGIT, _SPACE, _LINE, _STOP, _MARK, _SYMBOL, _BAR, _OTHER, _HIGH]] / n
        words, lines = text.split(), text.split("\n")
        if words:
            seen = Counter(words)
            row[11] = (n - counts[_SPACE] - counts[_LINE]) / len(words)
            row[12] = len(seen) / len(words)
            row[13] = max(seen.values()) / len(words)
            row[16] = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / len(words)
            row[17] = sum(c for w, c in seen.items() if w.isupper()) / len(words)
        row[14] = len(set(lines)) / len(lines)
        row[15] = np.log1p(n / len(lines))
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A step for each bin: the best split of the bins, and again, up to so many leaves."""
    parts = [(0, len(g))]
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))

    def best(part):
        low, high = part
        if high - low < 2:
            return 0.0, 0
        cut = np.arange(low + 1, high)
        left = (gs[cut] - gs[low]) ** 2 / (hs[cut] - hs[low] + RIDGE)
        right = (gs[high] - gs[cut]) ** 2 / (hs[high] - hs[cut] + RIDGE)
        gain = left + right - _leaf(gs[high] - gs[low], hs[high] - hs[low])
        k = int(np.argmax(gain))
        return float(gain[k]), int(cut[k])

    while len(parts) < leaves:
        gain, cut, part = max((*best(p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    step = np.empty(len(g))
    for low, high in parts:
        step[low:high] = (gs[high] - gs[low]) / (hs[high] - hs[low] + RIDGE)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features into four leaves: its gain and the step for each cell."""
    a, b = g.shape
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, at = -1.0, (1, 1)
    for i in range(1, a):
        for j in range(1, b):
            gain = sum(_leaf(*(s[r1, c1] - s[r0, c1] - s[r1, c0] + s[r0, c0] for s in (gs, hs))) for r0, r1, c0, c1 in _boxes(i, j, a, b))
            if gain > best:
                best, at = gain, (i, j)
    step = np.empty_like(g)
    for r0, r1, c0, c1 in _boxes(*at, a, b):
        step[r0:r1, c0:c1] = g[r0:r1, c0:c1].sum() / (h[r0:r1, c0:c1].sum() + RIDGE)
    return best - _leaf(g.sum(), h.sum()), step


def _boxes(i: int, j: int, a: int, b: int):
    return ((0, i, 0, j), (0, i, j, b), (i, a, 0, j), (i, a, j, b))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the features in turn, then the pairs that explain most of what is left.

    The number of rounds is the one that does best on every fifth row, which the
    trees don't see. Rows of one class only, or none, give a constant score.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0)
    if len(y) == 0 or y.min() == y.max():
        return Model(base, [empty] * x.shape[1], [np.zeros(1)] * x.shape[1], [], [empty] * x.shape[1], [])
    test = np.arange(len(y)) % 5 == 4
    weight = (~test).astype(float)
    if not test.any():  # under five rows
        test = ~test
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def loss():
        return float(np.logaddexp(0, np.where(y[test] > 0, -total[test], total[test])).mean())

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return (y - p) * weight, p * (1 - p) * weight

    def boosted(one_round, state):
        nonlocal total
        best, kept, at = loss(), [t.copy() for t in state], total.copy()
        for k in range(ROUNDS):
            one_round()
            if k % 5 == 4 and (now := loss()) < best:
                best, kept, at = now, [t.copy() for t in state], total.copy()
        total = at
        return kept

    def main_round():
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
            tables[j] += step
            total[:] += step[b]

    tables[:] = boosted(main_round, tables)

    pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]
    shape = lambda a, b: (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)

    def cells(a, b, v):
        n, m = shape(a, b)
        return np.bincount(coarse[a] * m + coarse[b], v, n * m).reshape(n, m)

    g, h = slopes()
    gains = [(_quadrants(cells(a, b, g), cells(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)]
    pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]

    def pair_round():
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _quadrants(cells(a, b, g), cells(a, b, h))[1]
            pair_tables[k] += step
            total[:] += step[coarse[a], coarse[b]]

    if pairs:
        pair_tables = boosted(pair_round, pair_tables)
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows that are not held out, at most fit_rows of them.

    Null labels and ids are no labels; an id with several counts as 1 if half of
    them are. Labels without a document, and documents with none, are left out.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("y"))
    )
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # bounded, so it may be broadcast
    joined = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            x = features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    fit_on = joined.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>")
    # an id that repeats has a row for each of its documents: the bound is on rows
    fit_on = fit_on.orderBy(F.xxhash64("id"), "id", "x").limit(fit_rows).orderBy("id", "x").select("y", "x").toArrow()
    x = fit_on["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(fit_on.num_rows, len(FEATURES))
    return fit(x, fit_on["y"].to_numpy().astype(float))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with score double and predicted int; columns of these names are replaced. Null counts as the empty text.

    Rows that repeat are scored each, alike; an empty table gives an empty one.
    """
    kept = docs.drop("score", "predicted")
    schema = kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    for field in ("score", "predicted"):
        schema[field].nullable = True

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text_col))):
            score = model.score(features(batch.column(batch.schema.get_field_index(text_col)).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    return kept.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
