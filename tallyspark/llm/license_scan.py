"""Licence scan: sparse TF-IDF cosine of stretches of text to templates, then inheritance by directory.

A file's own licence is its best stretch, anywhere in the whole text. Files that are
mostly a licence, or are named like one, pass it down to the files below their
directory that have none; the nearest directory wins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, text_of, written
from tallyspark.llm.licence_texts import templates as known_templates

THRESHOLD, FILE_SHARE = 0.8, 0.5
LICENCE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
_EDGES = "\"'()[]{}<>.,;:!?*/#"


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, without signs at their ends. One of signs alone is the empty word."""
    return [w.strip(_EDGES) for w in text.lower().split()] if text else []


@dataclass
class Matcher:
    """Templates as sparse vectors: the weight of term k in template i, for the terms of each template."""

    names: list[str]
    lengths: list[int]
    vocabulary: dict[str, int]
    idf: np.ndarray
    #: For each template, its terms and how often it has each.
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    def __post_init__(self):
        owner = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        term, weight = np.concatenate(self.terms), (np.concatenate(self.counts) * self.idf[np.concatenate(self.terms)]) ** 2
        self.norms = np.sqrt(np.bincount(owner, weight, len(self.terms)))
        order = np.argsort(term, kind="stable")
        self._owner, self._weight = owner[order], weight[order]
        self._start = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))

    def reached(self, present: np.ndarray, threshold: float) -> np.ndarray:
        """The templates that a text with these terms can be so similar to: no cosine is more than the share of the template's norm
        that they have."""
        at = np.concatenate([np.arange(self._start[t], self._start[t + 1]) for t in present])
        share = np.bincount(self._owner[at], self._weight[at], len(self.norms))
        return np.flatnonzero(np.sqrt(share) >= (threshold - 1e-9) * self.norms)

    def stretches(self, words: list[str], threshold: float, all_files: int) -> list[tuple[int, int, int, float, float, list[tuple[str, int]]]]:
        """(template, first word, words, dot product by the template's norm, square norm of the words that templates have, other words and
        how often) of stretches that may be a template's most similar one, and as similar as the threshold.

        A stretch has the template's length, or the text's if that is shorter. A word that no template has weighs 1
        at least, and at most what a word of one file of all does: this bounds the cosine from above and below.
        Left out is only what another stretch beats whatever its other words weigh.
        """
        rarest = float(inverse(np.float64(1), all_files))
        terms = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        present = np.unique(terms)
        present = present[present >= 0]
        if not len(present):
            return []
        known = np.append(0, np.cumsum(np.append(self.idf, 1.0)[terms] ** 2))
        found = []
        for i in self.reached(present, threshold):
            n = min(self.lengths[i], len(terms))
            mine = np.zeros(len(self.vocabulary) + 1)
            mine[self.terms[i]] = self.counts[i] * self.idf[self.terms[i]] ** 2
            dot = np.append(0, np.cumsum(mine[terms]))
            dot = dot[n:] - dot[:-n]
            # repeated words only make a stretch's norm larger than this
            bound = dot / np.sqrt(known[n:] - known[:-n]) / self.norms[i]
            some = np.flatnonzero(bound >= threshold - 1e-9)
            best, kept = 0.0, []
            for at in some[np.argsort(-bound[some], kind="stable")].tolist():
                if bound[at] < best - 1e-9:
                    break
                inside = Counter(words[at : at + n])
                own = sum((k * self.idf[self.vocabulary[w]]) ** 2 for w, k in inside.items() if w in self.vocabulary)
                others = [(w, k) for w, k in inside.items() if w not in self.vocabulary]
                least, most = (dot[at] / self.norms[i] / np.sqrt(own + sum((k * weight) ** 2 for _, k in others)) for weight in (rarest, 1.0))
                best = max(best, least)
                kept.append((most, (int(i), at, n, float(dot[at] / self.norms[i]), float(own), others)))
            found += [s for most, s in kept if most >= max(best, threshold) - 1e-9]
        return found


def frequencies(files: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """((word, files): how many files have each word, the number of files). Each task adds up its own before they meet."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0)):
            total = Counter()
            for text in batch.column(0).to_pylist():
                total.update(set(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "files"])

    counted = files.select(text_of(text_col).alias("text")).mapInArrow(run, "word string, files long")
    return written(counted.groupBy("word").agg(F.sum("files").alias("files")), "licence-words"), files.count()


def inverse(files: np.ndarray, all_files: int):
    return 1 + np.log((1 + all_files) / (1 + files))


def fit(found: DataFrame, all_files: int, templates: list[tuple[str, str]] | None = None) -> Matcher:
    """Templates weighted by the inverse document frequencies of their words in all files."""
    templates = known_templates() if templates is None else templates
    split = [words_of(text) for _, text in templates]
    vocabulary = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
    asked = found.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    seen = np.zeros(len(vocabulary))
    for r in found.join(F.broadcast(asked), "word").collect():  # at most the templates' words
        seen[vocabulary[r.word]] = r.files
    terms, counts = [], []
    for words in split:
        some = Counter(vocabulary[w] for w in words)
        terms.append(np.array(sorted(some), np.int64))
        counts.append(np.array([some[t] for t in sorted(some)], np.float64))
    return Matcher([n for n, _ in templates], [len(w) for w in split], vocabulary, inverse(seen, all_files), terms, counts)


STRETCHES = "array<struct<template:int,first:int,words:int,dot:double,own:double,others:array<struct<word:string,times:int>>>>"


def _candidates(matcher: Matcher, threshold: float, all_files: int, text_col: str, batches):
    fields = [("template", pa.int32()), ("first", pa.int32()), ("words", pa.int32()), ("dot", pa.float64()), ("own", pa.float64()),
              ("others", pa.list_(pa.struct([("word", pa.string()), ("times", pa.int32())])))]
    for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text_col))):
        found, sizes = [], []
        for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
            words = words_of(text)
            sizes.append(len(words))
            found.append([(*s[:5], [{"word": w, "times": k} for w, k in s[5]]) for s in matcher.stretches(words, threshold, all_files)])
        listed = pa.array([[dict(zip([f for f, _ in fields], s, strict=True)) for s in of] for of in found], pa.list_(pa.struct(fields)))
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text_col]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(sizes, pa.int32()), listed], [*(n for n, _ in kept), "words", "__found"])


def own_licences(files: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """files without their text, with licence, score, first_word, licence_words: the most similar stretch, null if none reaches the
    threshold; margin: how much more similar it is than the best stretch of another licence (null: none);
    stretches: all that reach the threshold, one a licence, the most similar first; words: of the whole text.

    Of equally similar stretches the longest counts, then the first, then the first template.
    """
    new = ["licence", "score", "first_word", "licence_words", "margin", "stretches", "words"]
    found, all_files = frequencies(files, text_col)
    matcher = fit(found, all_files, templates)
    kept = files.drop(*(n for n in new if n != text_col))
    names = F.array(*(F.lit(n) for n in matcher.names))
    out = kept.drop(text_col).withColumns({"words": F.lit(0), "__found": F.lit(None).cast(STRETCHES)})
    rows = kept.mapInArrow(partial(_candidates, matcher, threshold, all_files, text_col), out.schema)
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "licence-candidates")

    each = rows.where(F.size("__found") > 0).select("__row", F.posexplode("__found").alias("at", "s")).select("__row", "at", "s.*")
    others = each.select("__row", "at", F.explode("others").alias("o")).select("__row", "at", "o.word", "o.times")
    # stretches have few words of their own: the words' frequencies are joined, not the other way round
    weighed = others.join(found, "word").groupBy("__row", "at").agg(
        F.sum(F.pow(F.col("times") * (1 + F.log(F.lit(1.0 + all_files) / (1 + F.col("files")))), 2)).alias("more")
    )
    scored = each.drop("others").join(weighed, ["__row", "at"], "left").select(
        "__row", names[F.col("template")].alias("licence"), "first", F.col("words").alias("n"), "template",
        F.least(F.lit(1.0), F.round(F.col("dot") / F.sqrt(F.col("own") + F.coalesce("more", F.lit(0.0))), 12)).alias("score"),
    ).where(F.col("score") >= threshold)
    order = F.struct((-F.col("score")).alias("minus"), (-F.col("n")).alias("short"), "first", "template", "score", "n")
    best = scored.groupBy("__row", "licence").agg(F.min(order).alias("b"))
    listed = best.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("b.minus", "b.short", "b.first", "b.template", "licence", "b.score", "b.n"))).alias("of"))
    listed = listed.withColumn("of", F.transform("of", lambda s: F.struct(
        s["licence"].alias("licence"), s["score"].alias("score"), s["first"].alias("first_word"), s["n"].alias("licence_words"))))
    joined = rows.drop("__found").join(listed.withColumnRenamed("__row", "__of"), F.col("__row") == F.col("__of"), "left")
    top = F.get("of", F.lit(0))
    return joined.withColumns({
        **{n: top[n] for n in new[:4]}, "margin": top["score"] - F.get("of", F.lit(1))["score"], "stretches": F.col("of"),
    }).drop("of", "__of", "__row")


def inherit(found: DataFrame, path_col: str = "path") -> DataFrame:
    """found with inherited_licence, inherited_from (a directory) and effective_licence.

    Directories, not files, are joined to their ancestors. Of several licence files
    in a directory the best score counts, then the smallest path. Null paths inherit nothing.
    """
    parts = F.split(F.col(path_col), "/")
    directory = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(F.lit(""))
    files = found.withColumn("__dir", F.when(F.col(path_col).isNotNull(), directory))
    named = F.element_at(parts, -1).rlike(LICENCE_NAMES) | (F.col("licence_words") >= F.lit(FILE_SHARE) * F.col("words"))
    given = files.where(F.col("licence").isNotNull() & F.coalesce(named, F.lit(False))).groupBy(F.col("__dir").alias("above")).agg(
        F.min_by("licence", F.struct(-F.col("score"), F.col(path_col))).alias("given")
    )
    steps = F.split("__dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    dirs = files.select("__dir").where(F.col("__dir").isNotNull()).distinct()
    climbed = dirs.select("__dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "above"))
    nearest = climbed.join(given.where(F.col("above").isNotNull()), "above").groupBy("__dir").agg(
        F.max_by(F.struct("above", "given"), "depth").alias("from")
    )
    nearest = written(nearest.select(F.col("__dir").alias("__d"), F.col("from.above").alias("__above"), F.col("from.given").alias("__given")), "licence-dirs")
    none_of_its_own = F.col("licence").isNull()
    joined = files.drop("inherited_licence", "inherited_from", "effective_licence").join(nearest, F.col("__dir") == F.col("__d"), "left")
    return joined.withColumns({
        "inherited_licence": F.when(none_of_its_own, F.col("__given")),
        "inherited_from": F.when(none_of_its_own, F.col("__above")),
        "effective_licence": F.coalesce("licence", "__given"),
    }).drop("__dir", "__d", "__above", "__given")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """files without their text, and what own_licences and inherit add. Null and empty texts have no licence of
    their own. Equal paths are files like others. An empty table gives no rows."""
    return inherit(written(own_licences(files, text_col, templates=templates), "licences"), path_col)


def query(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    files = docs.select("doc_id", path.alias("path"), text_of().alias("text"))
    return scan(files).select(
        "doc_id", "path", "licence", "score", "first_word", "licence_words", "margin", "stretches", "inherited_licence", "inherited_from", "effective_licence"
    )
