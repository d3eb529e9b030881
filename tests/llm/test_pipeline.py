import base64
from collections import Counter

import pytest

import corpus_pipeline
from tallyspark.llm import byte_bpe, line_dedup, near_dedup, quality
from tests.llm.brute import near_classes
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, and the rows that each stage returned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / f"{k}.parquet")
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns(steps):
    assert all(f.columns == steps[0].columns and f.dtypes == steps[0].dtypes for f in steps[1:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_classifier(spark, steps):
    model = quality.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in steps[0].collect() if model.score(quality.features([r.text]))[0] >= 0.3}
    assert {r.doc_id for r in steps[1].collect()} == kept and 0 < len(kept) < steps[0].count()


def test_lines(steps):
    before = steps[1].collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for r in before for k in {key(x) for x in (r.text or "").split("\n")} if k)
    expected = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not (key(x) and seen[key(x)] >= 10)) for r in before}
    assert {r.doc_id: r.text for r in steps[2].collect()} == expected
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near(steps):
    before = steps[2].collect()
    expected = near_classes([(r.doc_id, r.text) for r in before], near_dedup.inverse_frequencies(steps[2]))
    assert rows(steps[3]) == Counter(tuple(r) for r in before if expected[r.doc_id][0] == r.doc_id)


def test_mixed(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert before.keys() == after.keys() and all(1 <= n <= 2 for n in after.values())


def test_encoded(steps):
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    texts = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in steps[4].collect())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in steps[5].collect()) == texts


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.select("doc_id", "decoded_sha256").collect()) == sorted(
        (r.doc_id, r.decoded_sha256) for r in steps[5].select("doc_id", "decoded_sha256").collect())
    assert line_dedup.SQL


def test_odd_and_empty_tables(spark, odd, none, monkeypatch):
    """Every stage takes nulls, empty and very long texts, repeated rows and clashing columns, and no rows at all."""
    docs = spark.read.parquet(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found, ids = out.collect(), {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in found} <= ids and (name == "quality classifier" or found)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns, name
    empty = spark.read.parquet(none)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
