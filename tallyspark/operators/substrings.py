"""Which texts hold which words: an inverted index of the words by their rarest run of characters.

Each word waits under one of its runs of three characters (or all of it, if it is shorter): the one
that the fewest texts have. Texts meet it by an equi-join on their own runs, and what meets is
verified. So neither side is compared with the other in whole, and either may be of any size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

GRAM = 3
#: A dictionary of so many rows or fewer is worked on the driver and goes to every task; a larger one is shuffled.
FEW = 20_000
#: A scope of so many words or fewer meets its texts as they are: they have about as many runs each.
LIGHT = 16


def few_rows(df: DataFrame) -> list[Row] | None:
    """The rows of a small table; None for one of more than FEW."""
    rows = df.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, in one pass over it."""
    if n == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def holding(texts: DataFrame, words: DataFrame, scope: list[str] | None = None, measured: bool = True, carried: list[str] | None = None) -> DataFrame:
    """(scope, text, word): each text with each of the words that it holds.

    texts: (scope, text), words: (scope, word), both without repeats. With scope columns only what agrees in
    them meets. Nulls meet nothing. An empty word is in every text. Case counts. Few words are placed by what is rare among
    themselves and go to every task; many are placed by what is rare in the texts, and shuffled. Words that are known to be many need
    not be looked at first (measured=False). carried: columns of texts that are returned too. Of many words, the scopes with
    few (LIGHT) are joined to their texts by scope alone, and only the others' texts are taken apart.
    """
    scope, carried = scope or [], carried or []
    words = words.select(*scope, "word").where("word IS NOT NULL")
    known = texts.where("text IS NOT NULL")
    found = few_rows(words) if measured else None
    if scope and found is None:
        held = words.groupBy(*scope).agg(F.count("*").alias("__n"))
        light, heavy = (held.where(test).select(*scope) for test in (F.col("__n") <= LIGHT, F.col("__n") > LIGHT))
        direct = known.join(words.join(light, scope, "left_semi"), scope).where(F.contains("text", "word")).select(*scope, *carried, "text", "word")
        return direct.unionByName(_by_grams(known.join(heavy, scope, "left_semi"), words.join(heavy, scope, "left_semi"), None, scope, carried))
    return _by_grams(known, words, found, scope, carried)


def _by_grams(known: DataFrame, words: DataFrame, found: list[Row] | None, scope: list[str], carried: list[str]) -> DataFrame:
    """holding by the index of runs; found: the words, if they are few."""
    key = [*scope, "gram"]
    sizes = list(range(GRAM + 1)) if found is None else sorted({min(len(r["word"]), GRAM) for r in found}) or [0]
    text_grams = known.select(*scope, *carried, "text", F.explode(F.concat(*(grams(F.col("text"), k) for k in sizes))).alias("gram"))
    if found is not None:
        placed = F.broadcast(words.sparkSession.createDataFrame(_placed(found, scope), words.withColumn("gram", F.lit("")).schema))
    else:
        size = F.least(F.char_length("word"), F.lit(GRAM))
        of_word = F.lit(None).cast("array<string>")
        for k in sizes:
            of_word = F.when(size == k, grams(F.col("word"), k)).otherwise(of_word)
        word_grams = words.select(*scope, "word", F.explode(of_word).alias("gram"))
        often = text_grams.join(word_grams.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count("*").alias("held"))
        rarest = F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), F.col("gram"))).alias("gram")
        placed = word_grams.join(often, key, "left").groupBy(*scope, "word").agg(rarest)
    return text_grams.join(placed, key).where(F.contains("text", "word")).select(*scope, *carried, "text", "word")


def _placed(rows: list[Row], scope: list[str]) -> list[tuple]:
    """(scope, word, gram): each word under the run that the fewest words of its scope have."""
    own = [(tuple(r[c] for c in scope), r["word"], {r["word"][i : i + GRAM] for i in range(max(1, len(r["word"]) - GRAM + 1))}) for r in rows]
    held = Counter((of, g) for of, _, several in own for g in several)
    return [(*of, word, min(several, key=lambda g: (held[of, g], g))) for of, word, several in own]


_QUANTIFIER = re.compile(r"[?*+]|\{(\d*),?\d*\}")


def _runs(pattern: str) -> Iterator[list[str]]:
    """The runs of plain characters that each alternative of a pattern must hold; what is not plainly so ends a run."""
    runs, run, i, depth = [], "", 0, 0

    def ended() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c, plain, step = pattern[i], "", 1
        if c == "|" and not depth:
            ended()
            yield runs
            runs = []
        elif c == "\\":
            step = 2
            following = pattern[i + 1 : i + 2]
            if following.isalnum():
                if following not in "bB":
                    ended()
                    if following not in "dDsSwWhHvVRAzZG":
                        yield []  # not read on: nothing is sure
                        return
            else:
                plain = following
        elif c == "[":
            ended()
            end = i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            step = end + 1 - i
        elif c in "()":
            ended()
            depth += 1 if c == "(" else -1
        elif c in ".?*+{}":
            ended()
        elif c not in "^$":
            plain = c
        found = _QUANTIFIER.match(pattern, i + step) if i + step < len(pattern) else None
        if plain and not depth:
            least = 1 if found is None or found[0] == "+" else 0 if found[0] in "?*" else int(found[1] or 0)
            run += plain if least else ""
            if found:
                ended()
        if found:
            ended()
            step += len(found[0])
        i += step
    ended()
    yield runs


def required(pattern: str | None) -> list[str]:
    """Words, one of which each text holds, in lower case, that the expression matches in any case; an empty one if none is sure."""
    if pattern is None:
        return []
    if re.search(r"\(\?[^i:]|\(\?i[^)]|\\Q|&&", pattern) or not pattern.isascii():
        return [""]
    found = [max((r.lower() for r in runs), key=len, default="") for runs in _runs(pattern.replace("(?i)", ""))]
    return [""] if "" in found else sorted(set(found))


def with_words(dictionary: DataFrame, pattern: str, regex: Column) -> DataFrame:
    """dictionary with a row for each word that stands for its pattern: the pattern in lower case, or the words that an expression requires.

    Null patterns go. A small dictionary is made anew and goes to every task; of a large one Python reads the expressions, in batches.
    """
    kept = dictionary.where(F.col(pattern).isNotNull()).withColumns({"__regex": regex, "__low": F.lower(pattern)})
    rows = few_rows(kept)
    if rows is not None:
        made = [(*(r[c] for c in dictionary.columns), w) for r in rows for w in (required(r[pattern]) if r["__regex"] else [r["__low"]])]
        return F.broadcast(dictionary.sparkSession.createDataFrame(made, dictionary.withColumn("word", F.lit("")).schema))

    @F.pandas_udf("array<string>")
    def of(values):
        return values.map(required)

    words = F.when(F.col("__regex"), of(F.when(F.col("__regex"), F.col(pattern)))).otherwise(F.array("__low"))
    return kept.withColumn("word", F.explode(words)).drop("__regex", "__low")
