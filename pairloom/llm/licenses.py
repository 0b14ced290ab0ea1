"""License scans: passages compared with license templates by the Dice coefficient.

A text is normalised to lower-case words (letters, digits and all non-ASCII characters; everything
else separates, line breaks too). A passage is any run of its words, compared with the templates as
a multiset of word pairs (bigrams). One that is enough like a template has so many pairs that some
template knows that it lies in a dense stretch of those; in each stretch all windows are compared
that the size of a template admits. Of windows that overlap those are reported whose common pairs,
weighed by likeness, have the greatest sum, so that licenses next to each other, inside a line
or around foreign words are told apart. Where licenses share most of their wording, likeness alone does not name them: a
window counts for one of them only if it holds the words of its name and version and no others' (``MARKS``).

Defined results: null counts as an empty text; every row gives one row, repeated ones too; spans go from the first letter of a passage to its last; a text
without a passage that reaches ``LEAST`` has no license, an empty list and likeness 0; equal coefficients go to
the first template in alphabetical order. Columns beyond ``doc_id`` and ``text`` are ignored. Empty
in, empty out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bytesets import Texts, chunks, mix, word_hashes, word_spans
from pairloom.llm.license_texts import MARKS, TEMPLATES

#: Least Dice coefficient of a match.
LEAST = 0.8

_U = np.uint64
_NORMAL = np.full(256, 0x20, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _NORMAL[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _NORMAL[_c] = _c + 32
_NORMAL[128:] = np.arange(128, 256)
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_UPPER))


def bigrams(of: list[str]) -> Counter:
    return Counter(zip(of, of[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all bigrams; 0 if there are none."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


#: Groups of phrases of which one must be there, and phrases that must not.
Marks = tuple[list[list[str]], list[str]]


class Templates:
    """Templates by the number of their bigrams, the hashes of all their bigrams, and the words that tell names apart."""

    def __init__(self, texts: dict[str, list[str]] = TEMPLATES, least: float = LEAST, marks: dict[str, Marks] = MARKS):
        self.least = least
        self.marks = marks
        forms = [(name, bigrams(words(t))) for name in sorted(texts) for t in texts[name]]
        self.forms = sorted(((b.total(), n, b) for n, b in forms if b), key=lambda x: (x[0], x[1]))
        self.sizes = [x[0] for x in self.forms]
        known = sorted({p for _, _, b in self.forms for p in b})
        self.ids = {p: i for i, p in enumerate(known)}
        #: How often each form has each known pair; the last column stands for all others.
        self.limits = np.zeros((len(self.forms), len(known) + 1), np.int32)
        for row, (_, _, form) in zip(self.limits, self.forms):
            for p, n in form.items():
                row[self.ids[p]] = n
        #: Least part of a matching window, and of its template, that is common to both.
        self.dense = least / (2 - least)
        #: Least number of known pairs in a match, and the greatest distance of the two nearest.
        self.fewest = max(1, math.ceil(self.dense * self.sizes[0] - 1e-9)) if self.sizes else 1
        self.gap = math.floor(2 / self.dense - 1 + 1e-9)
        raw = " ".join(w for p in known for w in p).encode()
        data = np.frombuffer(raw, np.uint8)
        block = Texts(0, data, np.array([0, len(data)]))
        self.known = np.unique(_pairs(word_hashes(block, *word_spans(block)))[::2])
        self.slots = np.zeros(1 << 16, bool)
        self.slots[(self.known >> _U(48)).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which bigram hashes some template has."""
        out = self.slots[(hashes >> _U(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        spot = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        out[at] = self.known[spot] == hashes[at]
        return out

    def best(self, of: Counter) -> tuple[float, str] | None:
        """The template most like a passage, if its likeness is enough."""
        size, least = of.total(), self.least
        best: tuple[float, str] | None = None
        # 2 * min / (min + max) bounds the coefficient
        lo = np.searchsorted(self.sizes, size * least / (2 - least) - 1e-9)
        hi = np.searchsorted(self.sizes, size * (2 - least) / least + 1e-9, "right")
        for _, name, form in self.forms[lo:hi]:
            value = dice(of, form)
            if value >= least and (best is None or (-value, name) < (-best[0], best[1])):
                best = value, name
        return best


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _U(0x9E3779B97F4A7C15) + hashes[1:])


class Match(NamedTuple):
    start: int  #: code points, the end exclusive
    end: int
    license: str
    dice: float


#: Windows compared at once.
_AT_ONCE = 1 << 20


def _stretches(ids: np.ndarray, templates: Templates) -> Iterator[tuple[int, int]]:
    """Where pairs are in some window with enough known ones; longer windows only join stretches."""
    level = np.concatenate([[0.0], np.cumsum((ids >= 0) - templates.dense)])
    lowest = np.minimum.accumulate(level)[:-1]
    highest = np.maximum.accumulate(level[::-1])[::-1][1:]
    inside = np.concatenate([[False], highest >= lowest - 1e-6, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


class _Phrases:
    """Where phrases stand in the words of one stretch."""

    def __init__(self, own: list[str]):
        self.own = own
        self.before: dict[str, np.ndarray] = {}

    def held(self, phrase: str, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether windows of so many pairs, which is one word more, hold the phrase."""
        of = phrase.split()
        if phrase not in self.before:
            first = [i for i, w in enumerate(self.own) if w == of[0] and self.own[i : i + len(of)] == of]
            marks = np.zeros(len(self.own) + 1, np.int64)
            marks[np.array(first, np.int64) + 1] = 1
            self.before[phrase] = np.cumsum(marks)
        before = self.before[phrase]
        last = np.minimum(np.maximum(starts, starts + sizes + 2 - len(of)), len(self.own))
        return before[last] > before[starts]


def _named(phrases: _Phrases, marks: Marks, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    needed, barred = marks
    out = np.ones(np.broadcast_shapes(starts.shape, sizes.shape), bool)
    for group in needed:
        out &= np.logical_or.reduce([phrases.held(p, starts, sizes) for p in group])
    for p in barred:
        out &= ~phrases.held(p, starts, sizes)
    return out


def _windows(ids: np.ndarray, own: list[str], templates: Templates) -> Iterator[tuple[int, int, float, float, str]]:
    """Of one stretch of pairs and its words, for each form and start the window that weighs most: start, end (of pairs),
    weight, likeness, name."""
    phrases = _Phrases(own)
    n, least, dense = len(ids), templates.least, templates.dense
    order = np.argsort(ids, kind="stable")
    rank = np.arange(n) - np.searchsorted(ids[order], ids[order])
    hits = int((ids >= 0).sum())
    for (size, name, _), limits in zip(templates.forms, templates.limits):
        if dense * size > hits + 1e-9:
            break  # forms rise in size
        limit = limits[ids]
        sums = np.concatenate([[0], np.cumsum(limit > 0)])
        width = min(n, math.floor(size / dense + 1e-9))
        starts = np.flatnonzero(limit > 0)
        starts = starts[sums[np.minimum(starts + width, n)] - sums[starts] >= dense * size - 1e-9]
        if not len(starts):
            continue
        # a pair counts in windows that start behind its place so many times ago as the form has it
        back = np.full(n, -1)
        far = rank >= limit[order]
        back[order[far]] = order[np.flatnonzero(far) - limit[order[far]]]
        back[limit == 0] = n
        back = np.concatenate([back, np.full(width, n)])
        sizes = np.arange(1, width + 1)
        step = max(1, _AT_ONCE // width)
        for k in range(0, len(starts), step):
            some = starts[k : k + step, None]
            common = np.cumsum(back[some + sizes - 1] < some, axis=1)
            likeness = 2 * common / (sizes + size)
            weight = np.where(likeness >= least, common * likeness, 0.0)
            if name in templates.marks and weight.any():
                weight = np.where(_named(phrases, templates.marks[name], some, sizes), weight, 0.0)
            best = np.argmax(weight, axis=1)
            row = np.arange(len(some))
            for i in np.flatnonzero(weight[row, best] > 0).tolist():
                j = int(best[i])
                start = int(some[i, 0])
                yield start, start + j + 1, float(weight[i, j]), float(likeness[i, j]), name


def _apart(windows: list[tuple]) -> list[tuple]:
    """Of windows, those that share no word and weigh most together."""
    windows.sort(key=lambda w: (w[1], -w[2], w[4], w[0]))
    ends = [w[1] for w in windows]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # weight so far, where to go on, taken
    for i, (start, _, weight, *_) in enumerate(windows):
        # a window of pairs has one word more than pairs
        before = bisect_right(ends, start - 1, 0, i)
        value = best[before][0] + weight
        best.append((value, before, True) if value > best[i][0] else (best[i][0], i, False))
    out, at = [], len(windows)
    while at:
        _, to, taken = best[at]
        if taken:
            out.append(windows[at - 1])
        at = to
    return out[::-1]


def find_matches(text: str, templates: Templates) -> list[Match]:
    """The licenses in one text, by place."""
    found = list(_WORD.finditer(text.translate(_UPPER)))
    own = [m[0] for m in found]
    get, none = templates.ids.get, -1
    ids = np.array([get(p, none) for p in zip(own, own[1:])], np.int64)
    out = []
    for lo, hi in _stretches(ids, templates):
        for start, end, _, value, name in _apart(list(_windows(ids[lo:hi], own[lo : hi + 1], templates))):
            out.append(Match(found[lo + start].start(), found[lo + end].end(), name, value))
    return out


def _suspects(texts: Texts, templates: Templates) -> np.ndarray:
    """Texts of a chunk with known pairs as near to each other as a match has them."""
    normal = Texts(texts.first, _NORMAL[texts.data], texts.starts)
    begin, end = word_spans(normal)
    if len(begin) < 2:
        return np.zeros(0, np.int64)
    text = np.searchsorted(texts.starts, begin, "right") - 1
    hit = np.flatnonzero(templates.has(_pairs(word_hashes(normal, begin, end))) & (text[1:] == text[:-1]))
    if templates.fewest > 1:
        near = (hit[1:] - hit[:-1] <= templates.gap) & (text[hit[1:]] == text[hit[:-1]])
        hit = hit[:-1][near]
    return np.unique(text[hit])


SCHEMA = "doc_id long, n_matches int, license string, dice double, licenses array<string>, spans string"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_matches", pa.int32()),
        ("license", pa.string()),
        ("dice", pa.float64()),
        ("licenses", pa.list_(pa.string())),
        ("spans", pa.string()),
    ]
)


def summary(matches: list[Match]) -> tuple:
    if not matches:
        return 0, None, 0.0, [], ""
    top = min(matches, key=lambda m: (-m.dice, m.license, m.start))
    names = sorted({m.license for m in matches})
    spans = ",".join(f"{m.license}:{m.start}:{m.end}" for m in matches)
    return len(matches), top.license, top.dice, names, spans


def _scan(batches: Iterable[pa.RecordBatch], texts_by_name: dict[str, list[str]], least: float) -> Iterator[pa.RecordBatch]:
    templates = Templates(texts_by_name, least)
    for batch in batches:
        column = batch.column("text")
        rows = [summary([])] * batch.num_rows
        for texts in chunks(column):
            for i in _suspects(texts, templates).tolist():
                rows[texts.first + i] = summary(find_matches(column[texts.first + i].as_py(), templates))
        columns = zip(*rows) if rows else [[] for _ in list(_ARROW)[1:]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:]))],
            schema=_ARROW,
        )


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """The licenses of every whole text: number of matches, the most alike, all names, and spans.
    Nothing is shuffled."""
    known = TEMPLATES if templates is None else templates
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: _scan(batches, known, least), SCHEMA)
