"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding is character for character: lower case, look-alike letters of other
scripts to Latin ones, and digits and signs that stand for letters to those.
Lexicon entries are whole words or word beginnings with a weight, the log of
how much more often texts labelled toxic hold them; at a place the heaviest
entry counts. Entries inside an exception phrase do not count. The evidence of
a text is normalised by its length, and a logistic curve fitted to the
labelled texts turns both into a score.

Fitting reads at most ``sample`` labelled texts (those whose id's hash falls
below the share that gives so many). Near copies among them are used once: of
texts that agree in one of a few min-hashes of their word triples, the first
stays, so that a text copied a hundred times does not fill the lexicon with its
words. Scoring is one pass without a shuffle; tasks receive the lexicon, of at
most ``MAX_ENTRIES`` entries.

Defined results: null and empty texts have no evidence and get the lowest
score; repeated rows stay; ids labelled several times are toxic if any label
says so; without a toxic label in the sample only the given words count; an
empty table gives an empty table; a text costs time in proportion to its length
and number of matches; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import ddl, mapped, place, plainly
from sheaf.llm.scratch import discard, stash
from sheaf.llm.words import NOT_SPACE, mix, runs, text_column, window_hashes

SAMPLE, MAX_ENTRIES, LEAST, STRENGTH = 20_000, 20_000, 3, 14.0
#: Terms of the labelled sample that the driver chooses entries from, those in most toxic texts first.
CANDIDATES = 100_000
#: Lengths of word beginnings that are tried as entries.
STEMS, STEM_GAIN = range(4, 10), 1.5
#: Words that count also where the labelled sample is too small to show it, and their weight.
SEED = dict.fromkeys(("idiot", "moron", "imbecile", "scum", "scumbag", "stupid", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "retard", "bastard"), 4.0)
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "pathetic fallacy", "clown fish", "clownfish", "sore loser", "pond scum", "class clown")
#: score >= LIMIT is predicted toxic.
LIMIT = 0.3

# Letters that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_FOLD = {ord(a): b for a, b in (LOOK_ALIKES | SUBSTITUTES).items()}
_FOLD |= {0xFF21 + i: chr(0x61 + i) for i in range(26)} | {0xFF41 + i: chr(0x61 + i) for i in range(26)}
_FOLD |= {0xFF10 + i: SUBSTITUTES.get(str(i), str(i)) for i in range(10)}
_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!|]+[^\W\d_]+)*|[0-9@$!|]+[^\W\d_]+(?:[0-9@$!|]+[^\W\d_]+)*")


def fold(text: str) -> str:
    """The folded text, of the same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[:1] or c for c in text)
    return low.translate(_FOLD)


@dataclass
class Lexicon:
    """words and stems: entry to weight. bias and slopes: of the logistic curve over evidence and evidence by length."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    bias: float = -3.0
    slopes: tuple[float, float] = (1.5, 0.5)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float, float, bool]] = {}
        for w in {*self.words, *self.stems, *map(fold, self.exceptions)}:
            entries[w] = (len(w), self.words.get(w, 0.0), self.stems.get(w, 0.0), w in set(map(fold, self.exceptions)))
        for w, x in entries.items():
            machine.add_word(w, x)
        if entries:
            machine.make_automaton()
        return machine if entries else None

    def score(self, evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b = _inputs(evidence, words)
        return 1 / (1 + np.exp(-(self.bias + self.slopes[0] * a + self.slopes[1] * b)))


def _inputs(evidence: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log1p(evidence), np.minimum(4.0, evidence / np.sqrt(words + 1.0))


def evidence(text: str, machine) -> tuple[float, list[tuple[int, int, float]]]:
    """The sum of weights of the matches that count, and those matches as (start, end, weight)."""
    if machine is None or not text:
        return 0.0, []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    last = len(text) - 1
    for end, (size, word, stem, exception) in machine.iter(fold(text)):
        start = end - size + 1
        if start and text[start - 1].isalpha():
            continue
        weight = stem
        if end == last or not text[end + 1].isalpha():
            weight = max(word, stem)
            if exception:
                spared.append((start, end + 1))
        if weight > best.get(start, (0, 0.0))[1]:
            best[start] = (end + 1, weight)
    found, upto, k = [], 0, 0  # both lists by start: upto is how far phrases reach that began at the match or before
    spared.sort()
    for s, (e, w) in sorted(best.items()):
        while k < len(spared) and spared[k][0] <= s:
            upto, k = max(upto, spared[k][1]), k + 1
        if e > upto:
            found.append((s, e, w))
    return sum(w for _, _, w in found), found


def _terms(text: str) -> set[str]:
    """The features of a text: "=word" and "^stem"."""
    words = {fold(w) for w in _WORD.findall(text.lower())}
    return {f"={w}" for w in words if 3 <= len(w) <= 40} | {f"^{w[:n]}" for w in words for n in STEMS if len(w) > n}


def _sketch(col: pa.Array, n: int) -> np.ndarray:
    """[text, n] min-hashes of word triples (0 for texts with fewer words)."""
    out = np.zeros((len(col), n), np.uint64)
    for run in runs(col, NOT_SPACE):
        h = window_hashes(run.hashes(), 3)
        owner = np.searchsorted(run.first, np.arange(len(h)), "right") - 1
        inside = np.arange(len(h)) + 3 <= run.first[owner + 1]
        h, owner = h[inside], owner[inside]
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for k in range(n):
            out[run.rows.start + owner[first], k] = np.minimum.reduceat(mix(h, k + 11), first)
    return out


def _distinct(rows: list[tuple[int, ...]]) -> list[int]:
    """The first elements of rows (sorted) none of whose sketch values was met before."""
    seen: list[set[int]] = [set() for _ in range(len(rows[0]) - 1)] if rows else []
    out = []
    for key, *sketch in rows:
        if any(x and x in s for x, s in zip(sketch, seen, strict=True)):
            continue
        for x, s in zip(sketch, seen, strict=True):
            s.add(x)
        out.append(key)
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, given: dict[str, float] = SEED) -> Lexicon:
    """The lexicon and curve of labelled documents; given: weights of words that the sample does not show to be toxic."""
    spark = docs.sparkSession
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = marks.count()
    share = min(1.0, max(0.0, sample - 4 * sqrt(sample)) / max(n, 1))
    chosen = marks.where((F.xxhash64("id") / F.lit(2.0**64)) + 0.5 < share)  # at most `sample` rows
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    labelled = stash(texts.join(F.broadcast(chosen), "id"), "labelled")
    known = labelled.select("id", "text", "y")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _sketch(text_column(batch, "text"), 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, k].view(np.int64)) for k in range(4))], names=["id", "a", "b", "c", "d"])

    kind = known.schema["id"].dataType.simpleString()
    rows = mapped(known, sketches, f"id {kind}, a long, b long, c long, d long").toArrow()
    keys = set(_distinct(sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True))))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = Counter(), Counter()
        n = [0, 0]
        for batch in batches:
            for i, t, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i in keys:
                    y = int(bool(y))
                    n[y] += 1
                    by[y].update(_terms(t))
        terms = ["", *{*by[0], *by[1]}]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1], *(by[1][t] for t in terms[1:])], pa.int64()), pa.array([n[0], *(by[0][t] for t in terms[1:])], pa.int64())], names=["term", "toxic", "clean"])

    table = mapped(known, counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = table.where((F.col("term") == "") | ((F.col("toxic") >= LEAST) & (F.col("toxic") >= 2 * F.col("clean"))))
    table = table.orderBy(F.col("term") != "", F.desc("toxic"), "clean", "term").limit(CANDIDATES + 1).toArrow()
    found = {t: (a, b) for t, a, b in zip(*(c.to_pylist() for c in table.columns), strict=True)}
    n_toxic, n_clean = found.pop("", (0, 0))
    lexicon = _chosen(found, n_toxic, n_clean)
    lexicon.words = {**given, **lexicon.words}
    points = measured(known, lexicon, "text").select("id", "y", "evidence", "n_words").toArrow()
    discard(labelled)
    ids, y, e, w = (c.to_pylist() for c in points.columns)
    own = [k for k, i in enumerate(ids) if i in keys]
    return _curve(lexicon, np.array([e[k] for k in own]), np.array([w[k] for k in own]), np.array([y[k] for k in own], float))


def _chosen(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """Terms much more frequent in toxic texts, as a likelihood ratio of at least exp(STRENGTH) says.

    A stem is an entry only if it stands for several words: it is found in
    STEM_GAIN times as many toxic texts as any one word that begins with it.
    """
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    ranked = []
    for term, (a, b) in found.items():
        weight = log((a + 0.5) / (n_toxic + 1)) - log((b + 0.5) / (n_clean + 1))
        base = (n_toxic + 1) / (n_toxic + n_clean + 2)
        strength = a * log((a / (a + b)) / base) + (b * log((b / (a + b)) / (1 - base)) if b else 0.0)
        if strength >= min(STRENGTH, LEAST * log(1 / base) * 1.5) and weight > 0:
            ranked.append((strength, term, weight))
    largest: dict[str, int] = {}  # of the words that begin with a stem
    for term, (a, _) in found.items():
        if term[0] == "=":
            for n in STEMS:
                largest[term[1 : n + 1]] = max(a, largest.get(term[1 : n + 1], 0))
    for _, term, weight in sorted(ranked, reverse=True)[:MAX_ENTRIES]:
        if term[0] == "=":
            words[term[1:]] = weight
        elif found[term][0] >= STEM_GAIN * largest.get(term[1:], 1):
            stems[term[1:]] = weight
    return Lexicon(words, stems)


def _curve(lexicon: Lexicon, e: np.ndarray, w: np.ndarray, y: np.ndarray) -> Lexicon:
    """Fit bias and slopes (not below 0) by Newton steps with a small ridge."""
    if not len(y) or y.sum() < 2 or y.sum() > len(y) - 2:
        return lexicon
    x = np.stack([np.ones(len(y)), *_inputs(e, w)], axis=1)
    ridge, c = np.diag([0.01, 0.3, 0.3]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c = c + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ c)
    lexicon.bias, lexicon.slopes = float(c[0]), (max(0.1, float(c[1])), max(0.0, float(c[2])))
    return lexicon


def _evidence(col: pa.Array, machine) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Evidence, number of words and matches of each text."""
    words = np.concatenate([r.counts() for r in runs(col, NOT_SPACE)] or [np.zeros(0, np.int64)])
    got = [evidence(t.as_py(), machine) for t in col]
    return np.array([x for x, _ in got], float), words, [x for _, x in got]


def measured(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with evidence, n_words, score and matches (columns of these names are replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    new = ["evidence", "n_words", "score", "matches"]
    named, names = plainly(docs, new)
    t = place(names, text)
    out_names = [*named.columns, *new]
    match = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value.automaton()
        for batch in batches:
            e, words, found = _evidence(text_column(batch, t), machine)
            spans = [[{"start": a, "end": b, "weight": w} for a, b, w in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(e, pa.float64()), pa.array(words, pa.int64()), pa.array(held.value.score(e, words), pa.float64()), pa.array(spans, match)], names=out_names)

    more = ", evidence double, n_words long, score double, matches array<struct<start:int,end:int,weight:double>>"
    return mapped(named, run, ddl(named.schema) + more).toDF(*names, *new)


def kept(docs: DataFrame, lexicon: Lexicon, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """docs, with the same columns, whose score is below the limit."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    named, names = plainly(docs)
    t = place(names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value.automaton()
        for batch in batches:
            e, words, _ = _evidence(text_column(batch, t), machine)
            yield batch.filter(pa.array(held.value.score(e, words) < limit, pa.bool_()))

    return mapped(named, run, named.schema).toDF(*names)
