import math
import random
from collections import Counter

from tallyspark.llm import license_scan, licence_texts
from tests.llm.conftest import SF


def by_force(texts, templates, threshold=0.8):
    """For each text (licence, score) of the most similar of all its stretches, from dictionaries; None below the threshold."""
    split = [[w.strip(license_scan._EDGES) for w in (t or "").lower().split()] for t in texts]
    files = Counter(w for words in split for w in set(words))
    weight = lambda w: 1 + math.log((1 + len(texts)) / (1 + files[w]))
    sought = [(name, words, Counter(words)) for name, words in ((n, license_scan.words_of(t)) for n, t in templates)]
    out = []
    for words in split:
        best, idf = (None, None), {w: weight(w) for w in {*words, *(w for _, t, _ in sought for w in t)}}
        for name, template, counted in sought:
            norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in counted.items()))
            # no stretch has more of the template than the whole text
            if math.sqrt(sum((k * idf[w]) ** 2 for w, k in counted.items() if w in set(words))) < threshold * norm:
                continue
            n = min(len(template), len(words))
            inside = Counter(words[:n])
            for at in range(len(words) - n + 1):
                if at:
                    inside[words[at - 1]] -= 1
                    inside[words[at + n - 1]] += 1
                dot = sum(k * inside[w] * idf[w] ** 2 for w, k in counted.items())
                if dot >= 0.5 * norm:
                    size = math.sqrt(sum((k * idf[w]) ** 2 for w, k in inside.items()))
                    cosine = dot / norm / size if size else 0
                    if cosine >= threshold and cosine > (best[1] or 0) + 1e-9:
                        best = (name, cosine)
        out.append(best)
    return out


def test_rare_words_at_either_end(spark):
    """The stretch with the rarer word beside it loses to the one without, on whichever side it stands."""
    template = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    fill = [f"zeta common{i % 3} word{i}" for i in range(200)]
    texts = [" ".join(["rarewordqqq", *template[1:], "zeta"]), " ".join(["zeta", *template[1:], "rarewordqqq"]), " ".join(template), *fill]
    files = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.licence, r.score) for r in license_scan.own_licences(files, templates=[("X-1", " ".join(template))]).collect()}
    expected = by_force(texts, [("X-1", " ".join(template))])
    assert [got[i][0] for i in range(3)] == ["X-1"] * 3
    for i, (name, score) in enumerate(expected):
        assert got[i][0] == name and (name is None or math.isclose(got[i][1], score, rel_tol=1e-9))


def test_random_stretches(spark):
    """Words of a template among rare and common ones, in every order: the best of all stretches, as by force."""
    rng = random.Random(6)
    templates = [("A-1", "a b c d e f g h"), ("B-1", "c d e x y"), ("C-1", "a a b b")]
    words = list("abcdefghxy") * 3 + ["common"] * 6
    texts = [" ".join(rng.choice([*words, f"rare{i}", f"rare{i}-{k}"]) for k in range(rng.randint(0, 25))) for i in range(400)]
    texts += [f"{f'only{i} ' * (i % 3)}a b c d e f g h{f' only{i}' * (i % 2)}" for i in range(30)]
    files = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.licence, r.score) for r in license_scan.own_licences(files, templates=templates).collect()}
    expected = by_force(texts, templates)
    assert sum(n is not None for n, _ in expected) > 40
    for i, (_, score) in enumerate(expected):
        assert (got[i][1] is None) == (score is None) and (score is None or math.isclose(got[i][1], score, rel_tol=1e-9)), (texts[i], got[i], expected[i])


def test_query_by_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in license_scan.query(docs).collect()}
    assert len(rows) == len(documents)
    expected = by_force([d["text"] for d in documents], licence_texts.templates())
    for d, (name, score) in zip(documents, expected, strict=True):
        r = rows[d["doc_id"]]
        assert (r.score is None) == (score is None) and (score is None or math.isclose(r.score, score, rel_tol=1e-6)), (d["doc_id"], r.score, score)
        assert name is None or name in [s.licence for s in r.stretches if s.score >= score - 1e-6]
    assert sum(r.licence is not None for r in rows.values()) > 5


def test_versions_and_variants_are_told_apart(spark):
    """Notices, whole licences and statements, inside other words, give their own licence and no neighbour."""
    texts = licence_texts.templates()
    filler = [f"other{i}" for i in range(40)]
    rows = [(i, name, " ".join([*filler[: i % 30], text, *filler[i % 40 :]])) for i, (name, text) in enumerate(texts)]
    files = spark.createDataFrame([(f"{i}/f.txt", name, text) for i, name, text in rows], "path string, want string, text string")
    found = license_scan.own_licences(files).collect()
    assert len(found) == len(rows) and [(r.want, r.licence) for r in found if r.licence != r.want] == []
    notice = dict(licence_texts.TEXTS)
    assert "version 3" in notice["GPL-3.0"] and "Lesser" in notice["LGPL-2.1"]


def test_nearest_directory(spark):
    mit = dict(licence_texts.TEXTS)["MIT"]
    rows = [("LICENSE", mit), ("src/a.py", "x"), ("src/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("src/lib/deep/b.py", None),
            ("src/lib/c.py", ""), ("src/libs/d.py", "y"), (None, "z"), ("src/lib/own.py", "word " * 40 + "Released under the MIT License." + " word" * 40)]
    files = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "path string, text string, given int")
    got = {r.path: (r.licence, r.inherited_licence, r.inherited_from, r.effective_licence) for r in license_scan.scan(files).collect()}
    assert got["LICENSE"] == ("MIT", None, None, "MIT")
    assert got["src/a.py"] == (None, "MIT", "", "MIT") == got["src/libs/d.py"]
    assert got["src/lib/deep/b.py"] == (None, "GPL-3.0", "src/lib", "GPL-3.0") == got["src/lib/c.py"]
    assert got["src/lib/own.py"] == ("MIT", None, None, "MIT") and got[None] == (None, None, None, None)


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    assert license_scan.query(docs).count() == docs.count()
    assert license_scan.query(spark.read.parquet(none)).count() == 0
