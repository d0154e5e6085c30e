"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter holds all languages: each slot is a bit mask with a bit for every
language, an n-gram sets its languages' bits in its slots, and the AND of its
slots is the mask of all languages that contain it. A text is decided by the
number of its n-grams for each language, corrected for the share of false
positives that the fill of the language's bit slice implies.

Fitting reads a bounded sample: at most ``sample`` labelled rows in all, as
many for each language (four standard deviations less are aimed at), those
whose id's hash falls below the language's share. What is
collected is the n-grams of that sample in at least ``least`` rows, at most
``top`` a language; of more languages than ``sample``, the most frequent are
learned. Prediction is one pass without a shuffle.

Defined results: null text or text without a letter is "und" with score 0; a
text none of whose n-grams is known gets the most frequent language with score
0; without labelled rows all texts are "und"; ties go to the language with more
labelled rows, then by name; repeated rows stay; an empty table gives an empty
table; labels and sources are not read when predicting; other columns, whatever
their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import ddl, mapped, place, plainly
from sheaf.llm.words import RUN_BYTES, buffers, mix, text_column

SIZES = (3, 4, 5)
SAMPLE, LEAST, TOP = 16_000, 3, 30_000
#: Slots of the filter as a power of two, hash functions, and the share of its best language's rate that an n-gram needs in another.
SLOT_BITS, HASHES, SHARE = 20, 3, 0.2
#: Bits of an n-gram's hash; the others of 64 number the text in its run.
GRAM_BITS = 52

#: Letters keep their bytes; ASCII that is no letter becomes a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x61], _FOLD[0x7B:0x80] = 0x20, 0x20


def _grams(col: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """In runs of whole texts: rows, and text (from 0 in the run) and hash of each n-gram without a space inside.

    A text's repeats of an n-gram count once, so that a line said over and over doesn't decide.
    """
    at, data = buffers(pc.utf8_lower(col))
    i, n = 0, len(at) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + RUN_BYTES, "right")) - 1), i + (1 << 64 - GRAM_BITS))
        first = np.arange(j - i + 1) + (at[i : j + 1] - at[i])
        buf = np.full(first[-1] + 1, 0x20, np.uint8)
        body = np.ones(len(buf), bool)
        body[first] = False
        buf[body] = _FOLD[data[at[i] : at[j]]]
        spaces = np.concatenate([[0], np.cumsum(buf == 0x20)])
        wide = buf.astype(np.uint64)
        keys = []
        for size in SIZES:
            m = len(buf) - size + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for k in range(size):
                h = (h << np.uint64(8)) | wide[k : m + k]
            inside = np.flatnonzero(spaces[size - 1 : m + size - 1] == spaces[1 : m + 1])
            doc = (np.searchsorted(first, inside, "right") - 1).astype(np.uint64)
            keys.append((doc << np.uint64(GRAM_BITS)) | (mix(h[inside], size) >> np.uint64(64 - GRAM_BITS)))
        key = np.sort(np.concatenate([*keys, np.zeros(0, np.uint64)]))
        key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
        yield slice(i, j), (key >> np.uint64(GRAM_BITS)).astype(np.int64), key & np.uint64((1 << GRAM_BITS) - 1)
        i = j


@dataclass
class Model:
    """Languages in order of preference, masks by slot (a plane for every 64 languages), and the share of false positives of each."""

    languages: list[str]
    planes: list[np.ndarray]
    false_share: np.ndarray

    @staticmethod
    def build(languages: list[str], grams: list[np.ndarray]) -> Model:
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        width = np.dtype(kind).itemsize * 8
        planes = [np.zeros(1 << SLOT_BITS, kind) for _ in range(0, max(1, len(languages)), width)]
        share = np.zeros(len(languages))
        for k, g in enumerate(grams):
            plane, bit = planes[k // width], kind(1 << (k % width))
            for slot in _slots(g):
                plane[slot] |= bit
            share[k] = ((plane & bit) != 0).mean() ** HASHES
        return Model(languages, planes, share)

    def counts(self, col: pa.Array) -> np.ndarray:
        """[text, language]: the corrected number of n-grams, and in a last column all n-grams."""
        out = np.zeros((len(col), len(self.languages) + 1))
        for rows, docs, h in _grams(col):
            n = rows.stop - rows.start
            slots = _slots(h)
            total = np.bincount(docs, minlength=n)
            for p, plane in enumerate(self.planes):
                mask = plane[slots[0]]
                for s in slots[1:]:
                    mask &= plane[s]
                width = plane.dtype.itemsize * 8
                for k in range(p * width, min(len(self.languages), (p + 1) * width)):
                    found = np.bincount(docs, weights=(mask >> plane.dtype.type(k - p * width)) & plane.dtype.type(1), minlength=n)
                    out[rows, k] = np.maximum(0, (found - total * self.false_share[k]) / (1 - self.false_share[k]))
            out[rows, -1] = total
        return out


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram."""
    return [(mix(h, k) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) for k in range(HASHES)]


def df_of(like: DataFrame, rows: list[tuple[str, float]]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "lang string, share double")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, least: int = LEAST, top: int = TOP) -> Model:
    """The model of a bounded sample of labelled rows (rows without text or language are left out)."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not known:
        return Model.build([], [])
    order = list(known)
    each = max(1, sample // len(order))
    part = [(x, min(1.0, max(1.0, each - 4 * each**0.5) / known[x])) for x in order]
    share = df_of(labelled, part)
    unit = (F.xxhash64("id") / F.lit(2.0**64)) + 0.5
    chosen = rows.join(F.broadcast(share), "lang").where(unit < F.col("share"))  # one row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([order.index(x) if x in known else -1 for x in batch.column(1).to_pylist()], np.int64)
            for part, docs, h in _grams(text_column(batch, "text")):
                code = langs[part][docs]
                for k in np.unique(code[code >= 0]):
                    g, n = np.unique(h[code == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k), pa.int32()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["k", "gram", "n"])

    table = mapped(chosen.select("id", "lang", "text"), count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    k, gram, n = (table.column(i).to_numpy() for i in range(3))
    size = np.array([min(each, known[x]) for x in order], float)
    grams, where = np.unique(gram, return_inverse=True)
    rate = np.zeros((len(grams), len(order)), np.float32) if len(order) * len(grams) < 50_000_000 else None
    if rate is None:  # many languages: by the best rate of each n-gram
        best = np.zeros(len(grams))
        np.maximum.at(best, where, n / size[k])
        keep = n / size[k] >= SHARE * best[where]
    else:
        rate[where, k] = n / size[k]
        keep = n / size[k] >= SHARE * rate.max(1)[where]
    out = []
    for i in range(len(order)):
        own = np.flatnonzero(keep & (k == i))
        own = own[np.argsort(-n[own], kind="stable")][:top]
        out.append(gram[own].view(np.uint64))
    return Model.build(order, out)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the winner's part of all languages' counts (columns of these names are replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    named, names = plainly(docs, ["lang_pred", "score"])
    t = place(names, text)
    out_names = [*named.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            col = text_column(batch, t)
            letters = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
            if model.languages:
                counts = model.counts(col)[:, :-1]
                best, total = counts.argmax(1), counts.sum(1)
                score = np.where(letters & (total > 0), counts[np.arange(len(best)), best] / np.maximum(total, 1e-9), 0.0)
                lang = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            else:
                score, lang = np.zeros(len(col)), ["und"] * len(col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=out_names)

    return mapped(named, run, ddl(named.schema) + ", lang_pred string, score double").toDF(*names, "lang_pred", "score")


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the fold as remainder (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
