import base64
import hashlib
import random
import struct
import sys

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import byte_bpe
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, documents, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {d["doc_id"]: expected(library, d["text"]) for d in documents}


def test_long_and_odd_texts(library):
    bpe = byte_bpe.encoder(*byte_bpe.public_ranks())
    for text in ("", " ", "  a  b\n\n c", "a" * 30000, "ab" * 9999 + "é", "😀" * 500, "\x00a \x00", "<|endoftext|>", "\t\n x  ", "１２ 34567", "don't  DON'T", "a  b"):
        assert list(struct.unpack(f"<{len(p := bpe.encode(text)) // 4}I", p)) == library.encode_ordinary(text), text[:20]
        assert bpe.decode(p) == text.encode()


def test_odd_rows(spark, odd, none, library):
    path = byte_bpe.public_ranks()
    docs = spark.read.parquet(odd)
    out = byte_bpe.encode(docs, *path)
    assert out.columns == [*docs.columns, "n_tokens", "token_ids"]
    for r in byte_bpe.decode(out, *path).collect():
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(spark.read.parquet(none), *path).count() == 0


def test_decode_of_ids_that_are_none(spark):
    rows = [(1, [72, None]), (2, [72, 10**9]), (3, [-1]), (4, []), (5, None), (6, [72]), (6, [72])]
    docs = spark.createDataFrame(rows, "i int, token_ids array<int>").withColumn("decoded", F.lit(1))
    out = byte_bpe.decode(docs, *byte_bpe.public_ranks())
    found = [(r.i, r.decoded) for r in out.collect()]
    assert out.columns == ["i", "token_ids", "decoded"] and len(found) == 7
    assert [x for i, x in found if i in (1, 2, 3, 5)] == [None] * 4 and dict(found)[4] == b"" and len([x for i, x in found if i == 6 and x]) == 2


def test_patterns_that_cross_spaces(spark):
    """A pattern whose matches hold spaces is not cut at them."""
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    assert byte_bpe.encoder(path, pattern).cuts
    crossing = r"\w+ \w+|\w+|\W+"
    library = tiktoken.Encoding("own", pat_str=crossing, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    texts = ["one two three four", "a b", " x y z ", ""]
    rows = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), path, crossing).collect()
    assert {r.i: list(r.token_ids) for r in rows} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_memory_stays_bounded(monkeypatch, library):
    """One dictionary of two generations, whatever the vocabulary; ids come out in parts, and the text does not come back."""
    path, pattern = byte_bpe.public_ranks()
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    bpe = byte_bpe.Encoder(byte_bpe.encoder(path, pattern).ranks, pattern)
    for k in range(400):
        text = f"word{k}x, it's word{k % 7}y"
        assert list(struct.unpack(f"<{len(p := bpe.encode(text)) // 4}I", p)) == library.encode_ordinary(text)
    remembered = [bpe, *(x for x in vars(bpe).values() if isinstance(x, dict) and x and all(isinstance(k, str) for k in x))]
    assert sum(map(len, remembered)) <= 100


def test_ids_come_out_in_parts(spark, monkeypatch, library):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"some words of text {i} " * 50) for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    monkeypatch.setattr(byte_bpe, "HELD", 2000)
    seen = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.update(run=run, names=schema.names) or self)
    byte_bpe.encode(docs, *byte_bpe.public_ranks(), ids=True, digests=True, texts=False)
    whole = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    parts = list(seen["run"](iter([whole])))
    assert len(parts) > 5 and all(p.schema.names == seen["names"] and "text" not in seen["names"] for p in parts)
    ids = {r["doc_id"]: r["token_ids"] for p in parts for r in p.to_pylist()}
    assert ids == {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}


def test_merges_of_many_pre_tokens_are_shared(spark, monkeypatch, library):
    """Distinct pre-tokens of a run of texts meet in one queue: calls are far fewer than with a queue for each."""
    import pyarrow as pa

    path, pattern = byte_bpe.public_ranks()
    bpe = byte_bpe.Encoder(byte_bpe.encoder(path, pattern).ranks, pattern)  # remembers nothing yet
    draw = random.Random(3)
    words = [" " + "".join(draw.choices(("th", "er", "in", "ou", "ä", "sch", "zu", "wh", "ble", "ti"), k=6)) for _ in range(20_000)]
    texts = ["".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    docs = spark.createDataFrame([], "text string")
    seen, calls = {}, 0
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.update(run=run) or self)
    monkeypatch.setattr(byte_bpe, "encoder", lambda *_: bpe)
    byte_bpe.encode(docs, path, pattern)

    def count(frame, event, what):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        parts = list(seen["run"](iter([pa.RecordBatch.from_pydict({"text": texts})])))
    finally:
        sys.setprofile(None)
    assert [x for p in parts for x in p.column("token_ids").to_pylist()] == [library.encode_ordinary(t) for t in texts]
    assert calls < 30 * len(words)


def test_many_pre_tokens_at_once_equal_the_library(library):
    """Runs that overlap, long pre-tokens and short ones beside each other."""
    path, pattern = byte_bpe.public_ranks()
    bpe = byte_bpe.Encoder(byte_bpe.encoder(path, pattern).ranks, pattern)
    draw = random.Random(5)
    letters = sorted(t for b in bpe.ranks if (t := b.decode(errors="replace")).isalpha() and len(t) < 9)
    words = ["a" * n for n in range(1, 40)] + ["psych" * n for n in (1, 2, 9, 90, 300)]
    words += ["".join(draw.choice(letters)[: draw.randint(1, 4)] for _ in range(draw.randint(2, 9))) for _ in range(8000)]
    texts = [*words, " ".join(words), "\n".join(words), "", "x\x00 \x00y", "\u3000 ".join(words[:500])]
    for got, text in zip(bpe.encode_all(texts), texts, strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode_ordinary(text), text[:40]


def test_smaller_ranks_that_come_up_go_first():
    """Ranks in any order: a merge may bring up a smaller one, which takes what the next place of the same rank needs."""
    import tiktoken

    _, pattern = byte_bpe.public_ranks()
    draw = random.Random(7)
    made = [["bcb", "bc"]] + [draw.sample(sorted({"".join(draw.choices("abc", k=draw.randint(2, 5))) for _ in range(30)}), 15) for _ in range(60)]
    words = ["bcbc", *("".join(draw.choices("abc", k=draw.randint(2, 40))) for _ in range(200))]
    turned = 0
    for tokens in made:
        ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        bpe = byte_bpe.Encoder(ranks, pattern)
        turned += bpe.pairs.turning.any()
        for got, word in zip(bpe.encode_all(words), words, strict=True):
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode_ordinary(word), (tokens, word)
    assert turned > 30
