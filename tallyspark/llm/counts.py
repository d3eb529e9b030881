"""Texts as slices of numbered words, and exact counts of any number of keys.

A slice is a run of texts in one row: its distinct words, and each text as their
numbers, so texts are split once. What slices hold of a key is added up in buckets of
the key space: a slice sends each of its distinct keys once to the key's bucket, and the
sums come back in the slice's order. No key's rows are more than the slices that hold it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import shuffle_partitions, slices

#: So many keys are added up at a time, on average.
BUCKET_KEYS = 1 << 20


def packed(values: np.ndarray) -> bytes:
    """The values' bytes by planes, lowest bytes first, compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys, as the steps between them."""
    return packed(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


class _Numbers(dict):
    """word -> its number, in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def word_slices(rows: DataFrame, split: Callable[[str], list], hashed: Callable[[object], int], apart: int | None = None) -> DataFrame:
    """rows: (id, text, part int) -> (slice, ids, parts, sizes, words, index, tokens).

    sizes: the tokens of each text. words: hashes of the distinct tokens, rising. index:
    each token's place in words. Two tokens with the same 64 bits of hash count as one.
    Texts of the part `apart` are in slices of odd numbers, all others in those of even numbers.
    """

    def kinds(batch: pa.RecordBatch) -> Iterable[tuple[int, pa.RecordBatch]]:
        odd = np.equal(batch.column(2).to_numpy(zero_copy_only=False), -1 if apart is None else apart)
        return ((k, some) for k, some in ((0, batch.filter(pa.array(~odd))), (1, batch.filter(pa.array(odd)))) if len(some))

    def run(batches):
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32, 2)
        for kind, batch in ((k, some) for whole in batches for part in slices(whole, 1) for k, some in kinds(part)):
            numbers, found = _Numbers(), []
            for text in batch.column(1).to_pylist():
                tokens = split(text)
                found.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
            words, place = np.unique(np.fromiter(map(hashed, numbers), np.uint64, len(numbers)), return_inverse=True)
            index = place.astype(np.int32)[np.concatenate(found)]
            columns = [
                pa.array([next(number) + kind]), _list(batch.column(0)), _list(batch.column(2)), pa.array([packed(np.array([len(f) for f in found], np.int64))]),
                pa.array([packed_keys(words)]), pa.array([packed(index)]), pa.array([len(index)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "ids", "parts", "sizes", "words", "index", "tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"slice long, ids array<{kind}>, parts array<int>, sizes binary, words binary, index binary, tokens long"
    return rows.select("id", "text", "part").mapInArrow(run, fields)


def _list(column: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)  # a filtered batch's columns start at 0


def bucket_bits(spark: SparkSession, keys: int) -> int:
    """The buckets grow with the keys, so that what is in one does not."""
    return math.ceil(math.log2(max(2 * shuffle_partitions(spark), keys / BUCKET_KEYS)))


ENTRIES = "slice long, kind int, bucket long, keys binary, n binary, deleted binary"
SUMS = "slice long, kind int, bucket long, n binary, deleted binary, types long, all_n long, all_deleted long"


def entries(number: int, kind: int, keys: np.ndarray, n: np.ndarray, deleted: np.ndarray, bits: int) -> Iterable[tuple]:
    """Rows of ENTRIES: a slice's rising distinct keys and what it has of each, by bucket."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(start, np.append(start[1:], len(keys)), strict=False):  # no start, no entry
        yield number, kind, int(bucket[a]), packed_keys(keys[a:b]), packed(n[a:b].astype(np.uint32)), packed(deleted[a:b].astype(np.uint32))


def batch_of(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names)


def totals(asked: DataFrame) -> DataFrame:
    """ENTRIES -> SUMS: each key's sums over all slices, in the order in which each slice has its keys. types: the bucket's distinct
    keys of which n is not 0, all_n and all_deleted: the sums over its keys; in one of the bucket's rows, and 0 in the others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [unpacked_keys(x.as_py()) for x in table["keys"]]
        found, index = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        sums = []
        for name in ("n", "deleted"):
            parts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in table[name]])
            sums.append(np.bincount(index, parts, len(found)).astype(np.int64))
        whole = np.zeros((3, len(keys)), np.int64)
        whole[:, 0] = np.count_nonzero(sums[0]), sums[0].sum(), sums[1].sum()
        back = [pa.array([packed(x) for x in np.split(s[index], ends)], pa.binary()) for s in sums]
        return pa.table([table["slice"], table["kind"], table["bucket"], *back, *map(pa.array, whole)], [f.split()[0] for f in SUMS.split(", ")])

    return asked.groupBy("kind", "bucket").applyInArrow(run, SUMS)


def sums_of(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, deleted) of all of a slice's keys of a kind, in their order; table: the slice's rows of SUMS."""
    rows = sorted((b, n, d) for k, b, n, d in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "n", "deleted")), strict=True) if k == kind)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([unpacked(n, np.int64) for _, n, _ in rows]), np.concatenate([unpacked(d, np.int64) for _, _, d in rows])
