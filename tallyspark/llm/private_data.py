"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the tokens of a text that hold a digit or an @ sign; other words count as no
entity. Neighbouring nodes are joined by the chain; nodes of a text that repeat or resemble
one another are joined across any distance, so that a label found in one place carries
to the others by loopy message passing. The weights are learned from the patterns' own finds
over the whole corpus, each kind of factor by itself from its counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, text_of, written

KINDS = ("email", "ip", "card", "phone")
OTHER, EMAIL, IP, CARD, PHONE = range(5)
LABELS = 5
#: A longer token is no node: it has what the patterns find in it.
LONGEST = 320

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMERIC = re.compile(r"[0-9][0-9. -]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@]\S*+")
_NO_DIGIT = re.compile(r"[^0-9]+")


def digits(value: str) -> str:
    return _NO_DIGIT.sub("", value)


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap: the characters before each @ sign, and the domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, by start and kind. Time is linear in the text."""
    found = [(a, EMAIL, b) for a, b in _emails(text)] if "@" in text else []
    for area in _NUMERIC.finditer(text):
        a, b = area.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text, a, b):
            number = digits(m[0])
            if 12 <= len(number) <= 19 and luhn(number):
                found.append((m.start(), CARD, m.end()))
    if "+" in text:
        found += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


_EDGE = "\"'`.,;:!?#%&*$~|<>[]{}=()_-/\\"


def tokens(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start and end of the token, start of its core, core) of the tokens that are nodes."""
    free = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start > free and end - start <= LONGEST and not text[start - 1].isspace():
            start -= 1
        free = end
        if end - start <= LONGEST:
            core = text[start:end].lstrip(_EDGE)
            at = end - len(core)
            if at > start and text[at - 1] == "(" and ")" in core and core[0].isdigit():  # of an area code
                at, core = at - 1, "(" + core
            core = core.rstrip(_EDGE)
            if core:
                yield start, end, at, core


NODES = "kinds array<int>, starts array<int>, ends array<int>, at array<int>, core array<string>, label array<int>, near array<boolean>"


def nodes(text: str) -> tuple[list, ...]:
    """A text's base spans, and its nodes: where the core starts, the core, the label that the patterns give it, whether
    one character parts it from the node before."""
    base = base_spans(text)
    found = list(tokens(text))
    starts, ends = [t[0] for t in found], [t[1] for t in found]
    label = [OTHER] * len(found)
    for a, kind, b in base:
        i = bisect_right(ends, a)
        while i < len(found) and starts[i] < b:
            label[i] = label[i] or kind
            i += 1
    near = [i > 0 and starts[i] - ends[i - 1] == 1 for i in range(len(found))]
    return [k for _, k, _ in base], [a for a, _, _ in base], [b for _, _, b in base], [t[2] for t in found], [t[3] for t in found], label, near


_GROUPS = re.compile(r"[0-9]+")


def shape(core: str) -> int:
    """A number under SHAPES for how a core looks: digits, letters, separators, and whether it could be each kind."""
    groups = _GROUPS.findall(core)
    n = sum(map(len, groups))
    letters = sum(map(str.isalpha, core))
    at = core.count("@")
    out = min(n, 20)
    for size, value in (
        (6, min(len(groups), 5)), (3, min(letters, 2)), (3, min(at, 2)), (2, "." in core), (2, "-" in core), (2, core[0] == "+"),
        (2, "(" in core or ")" in core), (2, 12 <= n <= 19 and luhn("".join(groups))), (2, at == 1 and "." in core.partition("@")[2]),
    ):
        out = out * size + int(value)
    return out


SHAPES = 21 * 6 * 3 * 3 * 2**6


def could_be(core: str, kind: int) -> bool:
    """Whether a core, or several joined by blanks, may be added as an entity of the kind."""
    if kind == EMAIL:
        local, _, domain = core.partition("@")
        return bool(local) and any(map(str.isalnum, domain)) and "@" not in domain
    if any(map(str.isalpha, core)) or "@" in core:
        return False
    groups = _GROUPS.findall(core)
    number = "".join(groups)
    if kind == IP:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == CARD:
        return 12 <= len(number) <= 19 and luhn(number)
    return 7 <= len(number) <= 15


#: Kinds of links: the chain's, and between nodes of one text that have the same core, digits or local part.
CHAIN, SAME, SUFFIX, LOCAL = range(4)


def _keys(core: str) -> Iterator[tuple[int, str]]:
    folded = core.casefold()
    number = digits(core)
    if len(number) >= 4 or "@" in core:
        yield SAME, folded
    if len(number) >= 7 and "@" not in core:
        yield SUFFIX, number[-7:]
    local, at, _ = folded.partition("@")
    if at and local:
        yield LOCAL, local


def links(cores: list[str], label: list[int], near: list[bool]) -> list[tuple[int, int, int]]:
    """(kind, node, node) of a text: neighbours, and every node with the first one of its key, which is one that
    the patterns labelled if there is any. So links are no more than nodes times kinds, however often a token repeats."""
    out = [(CHAIN, i - 1, i) for i, joined in enumerate(near) if joined]
    hubs: dict[tuple[int, str], int] = {}
    keys = [list(_keys(c)) for c in cores]
    for i, several in enumerate(keys):
        for key in several:
            h = hubs.setdefault(key, i)
            if label[i] and not label[h]:
                hubs[key] = i
    for i, several in enumerate(keys):
        seen = set()
        for kind, value in several:
            h = hubs[kind, value]
            if h != i and h not in seen:
                seen.add(h)
                out.append((kind, h, i))
    return out


COUNTS = "factor int, a int, b int, n long"


def _factor_counts(batches):
    """How often each factor has which labels: (-1, shape, label) of nodes, (kind, label, label) of links."""
    for batch in batches:
        counted: Counter = Counter()
        for cores, label, near in zip(*(batch.column(c).to_pylist() for c in ("core", "label", "near")), strict=True):
            counted.update((-1, shape(c), k) for c, k in zip(cores, label, strict=True))
            for kind, i, j in links(cores, label, near):
                counted[kind, label[i], label[j]] += 1
        rows = [(*key, n) for key, n in counted.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], [f.split()[0] for f in COUNTS.split(", ")])


@dataclass(frozen=True)
class Model:
    """Log potentials. shapes: those of the labels by shape; pairs: (4, LABELS, LABELS), of links; rare: of shapes not seen."""

    shapes: dict[int, np.ndarray]
    pairs: np.ndarray
    rare: np.ndarray
    missed: float

    def unary(self, core: str) -> np.ndarray:
        """A share `missed` of the probability goes evenly to the kinds that the core could be: the patterns do not find all."""
        known = self.shapes.get(shape(core), self.rare)
        may = np.array([1.0, *(could_be(core, k) for k in range(1, LABELS))])
        if not core.count("@") and not any(map(str.isalpha, core)):
            may[PHONE] = max(may[PHONE], 2 <= len(digits(core)) <= 15)  # a part of a number
        mixed = (1 - self.missed) * known + self.missed * may / may.sum()
        return np.log(mixed)


def learned(found: list[tuple[int, int, int, int]], missed: float = 0.05, doubt: float = 0.1) -> Model:
    """The model from rows of COUNTS, added up.

    A label's potential is its share among the nodes of a shape, drawn to the prior by one node. That of
    neighbours is how much likelier their labels are together than apart, drawn to 1 by five links. That of like nodes is one
    weight against different labels: the log odds that they agree, among links with an entity at an end. A link
    that disagrees there counts `doubt` only, since what the patterns missed looks so; before any data there are ten such, at odds of 400.
    """
    prior = np.array([0.96, 0.01, 0.01, 0.01, 0.01])
    shapes: dict[int, np.ndarray] = {}
    joint = np.zeros((4, LABELS, LABELS))
    for factor, a, b, n in found:
        if factor < 0:
            shapes.setdefault(a, np.zeros(LABELS))[b] += n
        else:
            joint[factor, a, b] += n
            joint[factor, b, a] += n
    shares = {s: (n + prior) / (n.sum() + 1) for s, n in shapes.items()}
    pairs = np.empty_like(joint)
    apart = np.outer(joint[CHAIN].sum(1), joint[CHAIN].sum(1)) / max(1, joint[CHAIN].sum())
    pairs[CHAIN] = np.log((joint[CHAIN] + 5) / (apart + 5))
    for kind in (SAME, SUFFIX, LOCAL):
        entity = joint[kind].sum() - joint[kind][OTHER, OTHER]
        same = np.trace(joint[kind]) - joint[kind][OTHER, OTHER]
        strength = np.log((same / 2 + 4000 * doubt) / ((entity - same) / 2 * doubt + 10 * doubt))
        pairs[kind] = np.where(np.eye(LABELS) > 0, 0, -max(0, strength))
    return Model(shares, pairs, prior, missed)


def beliefs(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of nodes by loopy sum-product messages over edges (kind, node, node), all sent at once in each round."""
    n, e = len(unary), len(edges)
    if not n:
        return np.zeros((0, LABELS))
    source, target = np.concatenate((edges[:, 1], edges[:, 2])), np.concatenate((edges[:, 2], edges[:, 1]))
    factor = pairs[np.concatenate((edges[:, 0], edges[:, 0]))]
    back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
    sent = np.zeros((2 * e, LABELS))

    def gathered() -> np.ndarray:
        return unary + np.stack([np.bincount(target, sent[:, k], n) for k in range(LABELS)], axis=1)

    for _ in range(rounds if e else 0):
        given = gathered()[source] - sent[back]
        new = given[:, :, None] + factor
        top = new.max(1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        sent = damping * sent + (1 - damping) * new
    out = gathered() if e else unary
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def added(at: list[int], cores: list[str], label: list[int], near: list[bool], chance: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of entities among the nodes without a label: neighbours of one kind that together could be one, else each by itself."""
    pick = chance.argmax(1)
    kind = [0 if label[i] or chance[i, k] < least else int(k) for i, k in enumerate(pick)]
    out, i = [], 0
    while i < len(kind):
        j = i + 1
        while kind[i] in (CARD, PHONE) and j < len(kind) and near[j] and kind[j] == kind[i]:
            j += 1
        if kind[i]:
            if could_be(" ".join(cores[i:j]), kind[i]):
                out.append((at[i], kind[i], at[j - 1] + len(cores[j - 1])))
            else:
                out += [(at[x], kind[i], at[x] + len(cores[x])) for x in range(i, j) if could_be(cores[x], kind[i])]
        i = j
    return out


def inferred(rows: list[tuple], model: Model, least: float) -> list[list[tuple[int, int, int]]]:
    """What the model adds to each of the rows (at, core, label, near); their texts' graphs are worked as one."""
    unary, edges, first = [], [], [0]
    for _, cores, label, near in rows:
        for core, k in zip(cores, label, strict=True):
            unary.append(_FIXED[k] if k else model.unary(core))
        edges += [(kind, i + first[-1], j + first[-1]) for kind, i, j in links(cores, label, near)]
        first.append(first[-1] + len(cores))
    chance = beliefs(np.array(unary).reshape(-1, LABELS), np.array(edges, np.int64).reshape(-1, 3), model.pairs)
    return [added(*row, chance[a:b], least) for row, a, b in zip(rows, first, first[1:], strict=False)]


#: A node that the patterns labelled keeps its label.
_FIXED = np.where(np.eye(LABELS) > 0, 0.0, -30.0)

SPANS = "kinds array<int>, starts array<int>, ends array<int>, added array<boolean>"


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end, added>>) for each row of docs, spans by start, then kind.

    Positions are code points, ends exclusive. added: not by the patterns but by the model, with
    probability `least` or more. A null text is an empty one and has no spans; rows that repeat are
    worked each; the id may be null and of any type. Other columns are not read. An empty table
    gives an empty one, and so does learning from it: then labels carry by the prior alone. A
    token of more than 320 characters has what the patterns find in it, no more.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def mark(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                columns = zip(*(nodes(t) for t in batch.column(1).to_pylist()), strict=True)
                schema = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.bool_()]
                arrays = [pa.array(c, pa.list_(t)) for c, t in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *(f.split()[0] for f in NODES.split(", "))])

    marked = written(read.mapInArrow(mark, f"id {id_type}, {NODES}"), "private-nodes")
    counted = marked.select("core", "label", "near").mapInArrow(_factor_counts, COUNTS).groupBy("factor", "a", "b").agg(F.sum("n").alias("n"))
    model = learned([tuple(r) for r in counted.orderBy("factor", "a", "b").collect()])  # at most SHAPES x 5 + 100 rows

    def infer(batches):
        for batch in batches:
            names = ("kinds", "starts", "ends", "at", "core", "label", "near")
            rows = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            out: list[tuple[list, ...]] = []
            for (kinds, starts, ends, *_), more in zip(rows, inferred([r[3:] for r in rows], model, least), strict=True):
                every = sorted([*((a, k, b, False) for a, k, b in zip(starts, kinds, ends, strict=True)), *((*m, True) for m in more)])
                out.append(([k for _, k, _, _ in every], [a for a, *_ in every], [b for _, _, b, _ in every], [x for *_, x in every]))
            types = [pa.int32()] * 3 + [pa.bool_()]
            arrays = [pa.array(c, pa.list_(t)) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *(f.split()[0] for f in SPANS.split(", "))])

    found = marked.mapInArrow(infer, f"id {id_type}, {SPANS}")
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(
        F.arrays_zip("kinds", "starts", "ends", "added"),
        lambda s: F.struct(F.element_at(names, s["kinds"]).alias("kind"), s["starts"].alias("start"), s["ends"].alias("end"), s["added"].alias("added")),
    )
    return found.select(F.col("id").alias(id_col), each.alias("spans"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(docs: DataFrame) -> DataFrame:
    """n_ and base_sha256 are of what the patterns find, n_added and spans of the model too."""
    found = entities(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: ~s["added"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(_of_kind(base, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )
