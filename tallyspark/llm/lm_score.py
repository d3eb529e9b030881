"""Language-model scoring by deleted interpolation.

All word bigrams are counted over the whole corpus, whatever its size. Bigram, unigram
and uniform estimates are mixed by weights for each bucket of the context's frequency;
expectation-maximisation learns the weights on held-out counts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import counts
from tallyspark.llm.common import text_of, written

#: Of the training texts, those of the remainder DELETED are held out from the counts that weights are learned with.
MODULUS, TEST, DELETED = 7, 2, 3
BUCKETS, ROUNDS = 48, 60
#: Held-out bigrams are added up for the weights by bucket and by their estimates, so many cells to a factor of two.
CELLS = 8
#: The level of an estimate of 0.
NEVER = -(1 << 20)
#: The end of a text; no word is like it. As a context it is the start of the next text.
END, END_HASH = b"\n", 0x5EED0FE4D
WORDS, PAIRS = 0, 1


def remainder(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % MODULUS


def _split(text: str) -> list[bytes]:
    """A text's words, A-Z in lower case, and its end."""
    found = text.encode().lower().split()
    found.append(END)
    return found


def _hashed(word: bytes) -> int:
    import xxhash

    return END_HASH if word == END else xxhash.xxh64_intdigest(word)


def _before(tokens: np.ndarray, end) -> np.ndarray:
    """What stands before each; every text ends with END, which so stands before the next."""
    return np.concatenate((np.full(1, end, tokens.dtype), tokens[:-1]))


def _pairs(words: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of a slice's distinct bigrams, rising; each token's place among them)."""
    word = words[index]
    x = _before(word, END_HASH)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(31)), return_inverse=True)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, index, sizes, the part of each token) of a slice."""
    sizes = counts.unpacked(row["sizes"], np.int64)
    part = np.repeat(np.array(row["parts"], np.int32), sizes)
    return counts.unpacked_keys(row["words"]), counts.unpacked(row["index"], np.int32), sizes, part


def _counted(bits: int, batches):
    """What each slice has of its words and bigrams, in training texts and of that in deleted ones."""
    for batch in batches:
        for row in batch.select(["slice", "parts", "sizes", "words", "index"]).to_pylist():
            words, index, _, part = _opened(row)
            pairs, place = _pairs(words, index)
            rows = []
            for kind, keys, of in ((WORDS, words, index), (PAIRS, pairs, place)):
                n, deleted = (np.bincount(of[some], minlength=len(keys)) for some in (part != TEST, part == DELETED))
                rows += counts.entries(row["slice"], kind, keys, n, deleted, bits)
            yield counts.batch_of(rows, counts.ENTRIES)


def bucket(context_counts: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context_counts + 1))).astype(np.int64)


def levels(estimates: np.ndarray) -> np.ndarray:
    out = np.full(len(estimates), NEVER, np.int64)
    some = estimates > 0
    out[some] = np.round(np.log2(estimates[some]) * CELLS)
    return out


def cells_of(context: np.ndarray, pair: np.ndarray, single: np.ndarray) -> dict[str, np.ndarray]:
    """Held-out bigrams added up by the bucket of the context and the levels of two estimates; all three without the held-out counts.

    single is a count: its share of all tokens follows when those are known.
    """
    of_pair = pair / np.maximum(1, context)
    names = np.stack([bucket(context), levels(of_pair), levels(single.astype(float))], axis=1)
    found, place = np.unique(names, axis=0, return_inverse=True)
    place = place.ravel()
    return {
        "bucket": found[:, 0], "pair_level": found[:, 1], "single_level": found[:, 2], "seen": np.bincount(place, minlength=len(found)),
        "pair": np.bincount(place, of_pair, len(found)).astype(float), "single": np.bincount(place, single, len(found)).astype(float),
    }


CELL = "bucket long, pair_level long, single_level long, seen long, pair double, single double"


def _cells(left: pa.Table, right: pa.Table) -> pa.Table:
    """The cells of a slice of held-out texts; right: its rows of sums."""
    words, index, _, _ = _opened(left.to_pylist()[0])
    _, place = _pairs(words, index)
    word_n, word_deleted = counts.sums_of(right, WORDS)
    pair_n, pair_deleted = counts.sums_of(right, PAIRS)
    word_rest, pair_rest = word_n - word_deleted, pair_n - pair_deleted
    cells = cells_of(word_rest[_before(index, np.searchsorted(words, np.uint64(END_HASH)))], pair_rest[place], word_rest[index])
    return pa.table({name: pa.array(values) for name, values in cells.items()})


def learned(which: np.ndarray, parts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(BUCKETS, 3) weights of the bigram, unigram and uniform estimate, by expectation-maximisation.

    which, parts, seen: the bucket, the three estimates and the held-out count of each
    row. A bucket that nothing was held out for takes its neighbour's weights below,
    and the first takes equal ones.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = weights[which] * parts
        share *= (seen / share.sum(1))[:, None]
        sums = np.stack([np.bincount(which, share[:, k], BUCKETS) for k in range(3)], axis=1)
        some = sums.sum(1) > 0
        # a little of each stays, so that no token of a new text has probability 0
        weights[some] = (sums[some] + 1e-3) / (sums[some].sum(1, keepdims=True) + 3e-3)
    filled = np.bincount(which, minlength=BUCKETS) > 0
    for b in range(1, BUCKETS):
        if not filled[b]:
            weights[b] = weights[b - 1]
    return weights


def mixture_weights(cells: DataFrame, tokens: int, types: int) -> np.ndarray:
    """The weights from the cells of all slices, whose number does not grow with the corpus but by the range of counts.
    tokens: those of the training texts that are not held out."""
    found = cells.groupBy("bucket", "pair_level", "single_level").agg(*(F.sum(c).alias(c) for c in ("seen", "pair", "single")))
    found = found.orderBy("bucket", "pair_level", "single_level").toPandas()
    seen = found["seen"].to_numpy(float)
    estimates = [found["pair"].to_numpy(float) / seen, found["single"].to_numpy(float) / seen / max(1, tokens), np.full(len(seen), 1 / (types + 1))]
    return learned(found["bucket"].to_numpy(np.int64), np.stack(estimates, axis=1), seen)


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _scored(weights: np.ndarray, tokens: int, types: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The scores of a slice's texts."""
    words, index, sizes, _ = _opened(left.to_pylist()[0])
    _, place = _pairs(words, index)
    word_n, pair_n = counts.sums_of(right, WORDS)[0], counts.sums_of(right, PAIRS)[0]
    context = word_n[_before(index, np.searchsorted(words, np.uint64(END_HASH)))]
    mix, n = weights[bucket(context)], word_n[index]
    logs = np.log10(mix[:, 0] * pair_n[place] / np.maximum(1, context) + mix[:, 1] * n / max(1, tokens) + mix[:, 2] / (types + 1))
    text = np.repeat(np.arange(len(sizes)), sizes)
    known = np.bincount(text, n > 0, len(sizes)).astype(np.int64)
    base = np.bincount(text, np.log10(n + 1), len(sizes)) - float(np.log10(tokens + (types + 1))) * sizes
    columns = [left["ids"].combine_chunks().flatten(), left["parts"].combine_chunks().flatten(), *map(pa.array, (sizes, known, base, np.bincount(text, logs, len(sizes))))]
    return pa.table(columns, ["id", "part", *(f.split()[0] for f in SCORES.split(", "))])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from the rows whose remainder is not TEST. A null text is an empty one:
    its only token is the end. A null id counts as the empty string. Rows that repeat
    are scored each. Without training rows counts are 0, and so is the vocabulary.
    Two words, or two bigrams, with the same 64 bits of hash count as one.
    """
    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), remainder(id_col).cast("int").alias("part"))
    sliced = written(counts.word_slices(kept, _split, _hashed, apart=DELETED), "lm-slices")
    bits = counts.bucket_bits(docs.sparkSession, sliced.agg(F.sum("tokens")).first()[0] or 0)
    sums = written(counts.totals(sliced.mapInArrow(partial(_counted, bits), counts.ENTRIES)), "lm-sums")
    total = sums.where(F.col("kind") == WORDS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "all_n", "all_deleted"))).first()
    held, of_held = (df.where(F.col("slice") % 2 == 1).groupBy("slice") for df in (sliced, sums))
    weights = mixture_weights(held.cogroup(of_held).applyInArrow(_cells, CELL), total.all_n - total.all_deleted, total.types)
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = sliced.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(
        partial(_scored, weights, total.all_n, total.types), f"id {id_type}, part int, {SCORES}"
    )
    return scored.select(
        F.col("id").alias(id_col), (F.col("part") == TEST).alias("held_out"), "n_tokens", "n_known",
        F.lit(total.all_n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def query(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
