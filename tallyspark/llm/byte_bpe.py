"""Byte-level BPE with a rank queue over a hierarchical bitmap.

Merges wait in buckets, one a merge rank. A bitmap of three levels tells which
buckets have entries; find-first-set gives the next rank. Entries whose pair has
changed meanwhile are stale and are skipped when they come up. The distinct
pre-tokens that a run of texts brings anew are in one queue together, and a
bucket is merged in all of them at once. A long pre-token has the queue for
itself: of n bytes, it takes O(n log n) steps, whatever its length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices

#: Distinct strings, pre-tokens or chunks between spaces, in each of the two generations that a worker remembers.
REMEMBERED = 400_000
#: Bytes of texts whose ids a worker holds at once; a longer text is alone.
HELD = 4 << 20
#: Bytes of a pre-token that has the queue for itself.
LONG = 512
#: Bytes of pre-tokens that are in the queue together.
TOGETHER = 1 << 19


# Fixed value: the pattern of which no match goes past a space between two characters that are not white space.
CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """The bitmap's three levels and the buckets, lists of any entries; empty between two uses."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def open(self, rank: int, bucket: list) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = bucket
        word = rank >> 6
        if not self.low[word]:
            if not self.middle[word >> 6]:
                self.top |= 1 << (word >> 6)
            self.middle[word >> 6] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def first(self) -> int:
        """The smallest rank that has a bucket: the first set bit, level by level."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.middle[word]
        word = (word << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> list:
        """The bucket of the smallest rank, which then has none."""
        word = rank >> 6
        self.low[word] = bits = self.low[word] & (self.low[word] - 1)
        if not bits:
            self.middle[word >> 6] = bits = self.middle[word >> 6] & ~(1 << (word & 63))
            if not bits:
                self.top &= self.top - 1
        return self.buckets.pop(rank)

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Places enter the buckets of their ranks; what is of one rank stays in order."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.open(rank, [places[start:end]])
            else:
                bucket.append(places[start:end])


class Pairs:
    """The rank of two tokens that follow each other, by binary search; -1 if they do not merge."""

    def __init__(self, ranks: dict[bytes, int]):
        cut = ((ranks.get(token[:i]), ranks.get(token[i:]), rank) for token, rank in ranks.items() for i in range(1, len(token)))
        found = np.array([x for x in cut if None not in x] or np.empty((0, 3)), np.int64)
        self.none = max(ranks.values()) + 1  # no token: stands between two pre-tokens
        keys = found[:, 0] * (self.none + 1) + found[:, 1]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(found[order, 2], -1)
        #: Tokens with which a pair of a smaller rank than their own can come up.
        self.turning = np.zeros(self.none, bool)
        self.turning[found[:, :2][found[:, :2] > found[:, 2:]]] = True

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * (self.none + 1) + right
        at = self.keys.searchsorted(keys)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


class Encoder(dict):
    """pre-token, or chunk between spaces -> its ids as little-endian 32-bit integers.

    Both are in one dictionary: a pre-token of CUT_AT_SPACES is one match on its own too. Once it is full it becomes
    the older generation, from which strings that come up again return; what did not come up meanwhile goes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pairs = Pairs(ranks)
        self.byte_tokens = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}
        self.cuts = pattern == CUT_AT_SPACES
        self.near_space = regex.compile(r"\s[ ]|[ ]\s|\x00").search

    def recall(self, piece: str) -> bytes | None:
        packed = self.get(piece)
        if packed is None:
            packed = self.older.get(piece)
            if packed is not None:
                self.remember(piece, packed)
        return packed

    def remember(self, piece: str, packed: bytes) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed

    def merge(self, piece: bytes) -> bytes:
        """The ids of one pre-token: the pair of the smallest rank, the leftmost first, is merged until none is left."""
        ranks, n = self.ranks, len(piece)
        rank_of, queue = ranks.get, self.queue
        following = list(range(1, n + 1))  # also where the part ends
        before = list(range(-1, n - 1))
        waiting = [-1] * n  # the rank of the pair that begins here
        entering = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        for rank, i in entering:
            waiting[i] = rank
        while True:
            for rank, i in entering:
                bucket = queue.buckets.get(rank)
                if bucket is None:
                    queue.open(rank, [i])
                else:
                    heapq.heappush(bucket, i)
            if not queue.top:
                break
            rank = queue.first()
            bucket = queue.buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.close(rank)
            entering = []
            if waiting[i] != rank:
                continue  # stale
            right = following[i]
            end = following[right]
            waiting[right] = waiting[i] = -1
            following[i] = end
            if end < n:
                before[end] = i
                new = rank_of(piece[i : following[end]])
                if new is not None:
                    waiting[i] = new
                    entering.append((new, i))
            left = before[i]
            if left >= 0:
                new = rank_of(piece[left:end])
                if new is None:
                    waiting[left] = -1
                elif waiting[left] != new:
                    waiting[left] = new
                    entering.append((new, left))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : following[i]]])
            i = following[i]
        return array("I", out).tobytes()

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as merge gives them. The smallest rank of all is the smallest of every pre-token that
        has it, so these are merged there at once, from left to right. Only where the new token could bring up a
        smaller rank, a pre-token's other places wait for that."""
        queue, pairs = self.queue, self.pairs
        lengths = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(lengths)  # of the pre-tokens; one place lies before each, and two after the last
        token = self.byte_tokens[np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0\0", np.uint8)]
        token[0] = token[-1] = pairs.none
        token[ends] = pairs.none
        owner = np.repeat(np.arange(len(pieces)), lengths)  # by place
        following = np.append(np.arange(1, len(token)), len(token) - 1)
        before = np.arange(-1, len(token) - 1)
        waiting = np.append(pairs(token[:-1], token[1:]), -1)  # the rank of the pair that begins here
        places = np.flatnonzero(waiting >= 0)
        while True:
            if len(places):
                queue.add(waiting[places], places)
            if not queue.top:
                break
            rank = queue.first()
            bucket = queue.close(rank)
            places = bucket[0]
            if len(bucket) > 1:
                places = np.sort(np.concatenate(bucket))
            places = places[waiting[places] == rank]  # others are stale
            if not len(places):
                continue
            if pairs.turning[rank]:
                whose = owner[places]
                later = np.append(False, whose[1:] == whose[:-1])
                if later.any():
                    queue.open(rank, [places[later]])
                    places = places[~later]
            right = following[places]
            if (right[:-1] == places[1:]).any():  # pairs that share a token: every other one of a run
                places = np.unique(places)
                begins = np.append(True, following[places][:-1] != places[1:])
                at = np.arange(len(places))
                places = places[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
                right = following[places]
            end = following[right]
            token[places], token[right] = rank, -1
            waiting[right] = -1
            following[places], before[end] = end, places
            changed = np.concatenate((places, before[places]))
            waiting[changed] = new = pairs(token[changed], token[following[changed]])
            places = changed[new >= 0]
        left = (token >= 0) & (token != pairs.none)
        packed = token[left].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.add.reduceat(left, ends - lengths, dtype=np.int64))
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def merged(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens."""
        out, together, held = {}, {}, 0
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data) if len(data) <= self.longest else None
            if whole is not None:
                out[piece] = array("I", [whole]).tobytes()
            elif len(data) > LONG:
                out[piece] = self.merge(data)
            else:
                together[piece] = data
                held += len(data)
                if held >= TOGETHER:
                    out.update(zip(together, self.merge_together([*together.values()])))
                    together, held = {}, 0
        if together:
            out.update(zip(together, self.merge_together([*together.values()])))
        return out

    def chunks(self, text: str) -> list[str]:
        """No match of CUT_AT_SPACES goes past a space between two characters that are not white space:
        it ends before it. Such texts are cut there, and the chunks are remembered. Other patterns split the whole text."""
        if not self.cuts or self.near_space(text):
            return self.split(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. What no text before had is merged together."""
        found, splits, pieces = {}, {}, {}
        cut = [[*map(found.setdefault, chunks, chunks)] for chunks in map(self.chunks, texts)]  # one string of each kind
        for chunk in found:
            found[chunk] = packed = self.recall(chunk)
            if packed is None:
                splits[chunk] = split = self.split(chunk) if self.cuts else [chunk]
                for piece in split:
                    if piece not in pieces:
                        pieces[piece] = self.recall(piece)
        new = self.merged([piece for piece, packed in pieces.items() if packed is None])
        pieces.update(new)
        for piece, packed in new.items():
            self.remember(piece, packed)
        for chunk, split in splits.items():
            found[chunk] = b"".join(map(pieces.__getitem__, split))
            if len(split) != 1:
                self.remember(chunk, found[chunk])
        return [b"".join(map(found.__getitem__, chunks)) for chunks in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", packed)))


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process. path: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = True, digests: bool = False, texts: bool = True) -> DataFrame:
    """All columns of docs (but the text without texts), and n_tokens long, and with ids: token_ids array<int>; with digests:
    ids_sha256 and decoded_sha256.

    Null counts as the empty text, which has no ids. path: the file of ranks, on every
    executor. Columns of docs with the new names are replaced. Rows that repeat are encoded each; an
    empty table gives an empty one.
    """
    new = ["n_tokens"] + ["token_ids"] * ids + ["ids_sha256", "decoded_sha256"] * digests
    kept = docs.drop(*new)
    types = {"n_tokens": "long", "token_ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    out = kept if texts else kept.drop(text_col)
    for name in new:
        out = out.withColumn(name, F.lit(None).cast(types[name]))

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, at, HELD):
                packed = bpe.encode_all([value or "" for value in part.column(at).to_pylist()])
                n = [len(one) // 4 for one in packed]
                if digests:
                    sums = [hashlib.sha256(one).hexdigest() for one in packed]
                    backs = [hashlib.sha256(bpe.decode(one)).hexdigest() for one in packed]
                passed = [i for i in range(part.num_columns) if texts or i != at]
                columns = [*(part.column(i) for i in passed), pa.array(n, pa.int64())]
                if ids:
                    offsets = pa.array([0, *_running(n)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(packed))])))
                if digests:
                    columns += [pa.array(sums, pa.string()), pa.array(backs, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*(part.schema.names[i] for i in passed), *new])

    return kept.mapInArrow(run, out.schema)


def _running(values):
    total = 0
    for v in values:
        total += v
        yield total


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns, and decoded binary: the bytes of the ids. Null ids, and ids with a null or with one that no rank has, give null; a
    column of that name is replaced. Rows that repeat are decoded each; an empty table gives an empty one."""
    def bytes_of(ids: list | None, known: dict) -> bytes | None:
        parts = None if ids is None else [known.get(i) for i in ids]
        return None if parts is None or None in parts else b"".join(parts)

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            decoded = [bytes_of(x, bpe.bytes_of) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(None).cast("binary")).schema)


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text"), *public_ranks(), ids=False, digests=True, texts=False)
