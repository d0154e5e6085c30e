"""Benchmark decontamination by n-gram windows.

The windows of the benchmark items, normalised to lower-case words, form a hash
set that every task holds: sorted hashes, each with the items that hold the
window and one place in the items' words, by which every hit is verified byte by
byte. Training texts are scanned once, window by window. There is no shuffle.

The set is broadcast only after its size is checked: benchmark tables are
curated and small, but MAX_BYTES of benchmark text is the proven bound (a set
takes about seven times its text). Beyond it the benchmark is dealt in blocks,
of which the driver holds one at a time; the scan runs once for each block over
numbered texts, what it hits is written, and the hits of all blocks are joined
to their texts by number.

Defined results: a null or empty text has no words, is never contaminated
and has no items; an item without words never occurs; repeated items and
repeated rows count each on their own; item_id may be of any type, and items with
a null id count as one item that is in no list of ids; empty tables, on either
side, give no hits; texts and items may be of any length; other columns,
whatever their names, are carried along by the cleaning functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import ddl, mapped, place, plainly
from sheaf.llm.scratch import discard, stash
from sheaf.llm.words import ALNUM_OR_HIGH, LOWER_ASCII, runs, text_column, window_hashes

#: Words in a window, and the share of hit words from which a document counts as contaminated.
SIZE, SHARE = 13, 0.05
#: Bytes of benchmark text that one broadcast set may hold.
MAX_BYTES = 32_000_000


class Windows:
    """The distinct windows of some items.

    By length: sorted hashes (a hash twice if two windows share it), the place
    of a window's first word among all words, and the items that hold it, as
    ranges of one list.
    """

    def __init__(self, items: list[tuple[str | None, str]], size: int) -> None:
        self.ids = [x for x, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        bufs, starts, ends, at_byte, at_word = [], [], [], 0, 0
        for run in runs(texts, ALNUM_OR_HIGH, LOWER_ASCII):
            h = run.hashes()
            for d, (a, b) in enumerate(zip(run.first[:-1].tolist(), run.first[1:].tolist(), strict=True)):
                if a < b:
                    n = min(size, b - a)
                    w = window_hashes(h[a:b], n)
                    found.setdefault(n, []).append((w, np.arange(a, a + len(w)) + at_word, np.full(len(w), run.rows.start + d, np.int32)))
            bufs.append(run.buf)
            starts.append(run.start + at_byte)
            ends.append(run.end + at_byte)
            at_byte += len(run.buf)
            at_word += len(run.start)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.buf, self.start, self.end = join(bufs, np.uint8), join(starts, np.int64), join(ends, np.int64)
        self.of = {n: self._distinct(n, *(np.concatenate(x) for x in zip(*parts, strict=True))) for n, parts in found.items()}
        self.first_bits = {n: self._bits(x[0]) for n, x in self.of.items()}

    def words(self, at: int, n: int) -> bytes:
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True))

    def _distinct(self, n: int, h: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """hash, place, begin in items, and items, a row for each distinct window."""
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(h)))
        for k in np.flatnonzero(size > 1).tolist():  # windows found several times: by their words, in case two share a hash
            a, b = int(begin[k]), int(begin[k] + size[k])
            own = [self.words(int(x), n) for x in at[a:b]]
            if len(set(own)) > 1:
                by = sorted(range(b - a), key=own.__getitem__)
                at[a:b], item[a:b] = at[a:b][by], item[a:b][by]
                new[a:b] = [i == 0 or own[by[i]] != own[by[i - 1]] for i in range(b - a)]
        begin = np.flatnonzero(new)
        return h[begin], at[begin], np.append(begin, len(h)), item

    @staticmethod
    def _bits(hashes: np.ndarray) -> tuple[int, np.ndarray]:
        """A bit table over the top bits, which turns most misses away before the search."""
        shift = 64 - max(16, min(24, len(hashes).bit_length() + 6))
        table = np.zeros(1 << (64 - shift), bool)
        table[hashes >> np.uint64(shift)] = True
        return shift, table

    def hits(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of n words whose hash is in the set, and the first row of that hash."""
        w = window_hashes(h, n)
        shift, table = self.first_bits[n]
        maybe = np.flatnonzero(table[w >> np.uint64(shift)])
        held = self.of[n][0]
        at = np.searchsorted(held, w[maybe])
        same = held[np.minimum(at, len(held) - 1)] == w[maybe]
        return maybe[same], at[same]

    def verified(self, n: int, row: int, words: bytes) -> np.ndarray:
        """The items that hold a window whose hash is that of the row."""
        held, at, begin, item = self.of[n]
        k = row
        while k < len(held) and held[k] == held[row]:
            if self.words(int(at[k]), n) == words:
                return item[begin[k] : begin[k + 1]]
            k += 1
        return item[:0]


def scan(col: pa.Array, windows: Windows) -> Iterator[tuple[int, set[str | None], list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """For each text in order: words, ids of items found, covered word ranges, and the words' byte starts and ends in the text."""
    for run in runs(col, ALNUM_OR_HIGH, LOWER_ASCII):
        h, docs = run.hashes(), len(run.first) - 1
        found: dict[int, set[str | None]] = {}
        ranges: dict[int, list[tuple[int, int]]] = {}
        for n in windows.of:
            starts, rows = windows.hits(h, n)
            owner = np.searchsorted(run.first, starts, "right") - 1
            inside = starts + n <= run.first[owner + 1]
            for s, k, d in zip(starts[inside].tolist(), rows[inside].tolist(), owner[inside].tolist(), strict=True):
                who = windows.verified(n, k, b" ".join(run.word(i) for i in range(s, s + n)))
                if len(who):
                    found.setdefault(d, set()).update(windows.ids[i] for i in who.tolist())
                    ranges.setdefault(d, []).append((s - int(run.first[d]), s - int(run.first[d]) + n))
        for d in range(docs):
            a, b = run.first[d], run.first[d + 1]
            yield int(b - a), found.get(d, set()), union(ranges.get(d, [])), run.start[a:b] - run.text_at[d], run.end[a:b] - run.text_at[d]


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges, sorted and merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most max_bytes of text (an item longer than that is a block of its own), one at a time."""
    block: list[tuple[str | None, str]] = []
    size = 0
    named, names = plainly(benchmark)
    i, t = place(names, id_col), place(names, text_col)
    for x in named.where(F.col(t).isNotNull()).select(F.col(i).cast("string"), F.col(t).cast("string")).toLocalIterator():
        n = len(x[1].encode())
        if block and size + n > max_bytes:
            yield block
            block, size = [], 0
        block.append((x[0], x[1]))
        size += n
    yield block


_PAIR = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_HITS_TYPE = pa.struct([("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(_PAIR)), ("cuts", pa.list_(_PAIR))])
_HITS_DDL = "hits struct<n_words:bigint,item_ids:array<string>,spans:array<struct<start:int,end:int>>,cuts:array<struct<start:int,end:int>>>"


def _pairs(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in ranges]


def _sorted(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda x: (x is None, x or ""))


def _scanned(docs: DataFrame, text: str, windows: Windows, only_hits: bool) -> DataFrame:
    """docs (with plain names) with a column hits; only_hits: without their text, and only those with any."""
    held = docs.sparkSession.sparkContext.broadcast(windows)
    out = docs.drop(text) if only_hits else docs
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [{"n_words": n, "item_ids": _sorted(ids), "spans": _pairs(ranges), "cuts": _pairs([(int(start[a]), int(end[b - 1])) for a, b in ranges])} for n, ids, ranges, start, end in scan(text_column(batch, text), held.value)]
            done = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hits, _HITS_TYPE)], names=[*names, "hits"])
            yield done.filter(pa.array([bool(x["spans"]) for x in hits], pa.bool_())) if only_hits else done

    return mapped(docs, run, f"{ddl(out.schema)}, {_HITS_DDL}" if names else _HITS_DDL)


def _tagged(docs: DataFrame, text: str, benchmark: DataFrame, size: int, max_bytes: int, item_id: str, item_text: str) -> DataFrame:
    """docs (with plain names) with a column of what the windows of all blocks hit: item ids, word ranges and their byte ranges."""
    dealt = blocks(benchmark, item_id, item_text, max_bytes)
    block, after = next(dealt), next(dealt, None)
    if after is None:
        return _scanned(docs, text, Windows(block, size), only_hits=False)
    numbered = stash(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = []
    while block is not None:
        parts.append(stash(_scanned(numbered.select("row", text), text, Windows(block, size), only_hits=True), "hits"))
        block, after = after, next(dealt, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                ids = {i for x in found for i in x["item_ids"]}
                both = sorted((a["start"], a["end"], c["start"], c["end"]) for x in found for a, c in zip(x["spans"], x["cuts"], strict=True))
                spans = union([(a, b) for a, b, _, _ in both])
                first = np.searchsorted([a for a, _, _, _ in both], [a for a, _ in spans])
                cuts = [(both[i][2], max(x[3] for x in both[i:j])) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(both)], strict=True)]
                out.append({"n_words": found[0]["n_words"], "item_ids": _sorted(ids), "spans": _pairs(spans), "cuts": _pairs(cuts)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _HITS_TYPE)], names=["row", "hits"])

    merged = stash(mapped(every.groupBy("row").agg(F.collect_list("hits").alias("hits")), merge, f"row long, {_HITS_DDL}"), "hits")
    discard(*parts)
    none = _scanned(numbered, text, Windows([], size), only_hits=False).withColumnRenamed("hits", "none")
    return none.join(merged, "row", "left").select(*docs.columns, F.coalesce("hits", "none").alias("hits"))


def _report(parts: int) -> list[Column]:
    n_hit = F.aggregate(F.col("hits.spans"), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.col("hits.item_ids")
    n_words = F.col("hits.n_words")
    return [
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((n_hit > 0) & (parts * n_hit >= n_words)).alias("contaminated"),
    ]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, share: float = SHARE, item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans (hit word ranges)."""
    named, names = plainly(docs)
    rows = named.select(F.col(place(names, doc_id)).alias("doc_id"), F.col(place(names, text)).alias("text"))
    tagged = _tagged(rows, "text", benchmark, size, max_bytes, item_id, item_text)
    return tagged.select("doc_id", *_report(round(1 / share)), "hits.item_ids", "hits.spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "document", size: int = SIZE, share: float = SHARE, item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs, with the same columns, without contaminated documents (mode "document"), hit words ("span"), or both.

    A cut goes from the first hit word of a range to its last, and what lies
    between cuts stays as it is; a text without hits is kept.
    """
    if mode not in ("document", "span", "both"):
        raise ValueError(f"mode must be 'document', 'span' or 'both', not {mode!r}")
    named, names = plainly(docs)
    t = place(names, text)
    tagged = _tagged(named, t, benchmark, size, max_bytes, item_id, item_text)
    if mode != "span":
        tagged = tagged.where(~_report(round(1 / share))[-1])
    if mode == "document":
        return tagged.drop("hits").toDF(*names)
    raw, cuts = F.encode(F.col(t), "UTF-8"), F.col("hits.cuts")
    upto = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(F.octet_length(F.col(t))))
    since = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["end"]))
    kept = F.transform(F.arrays_zip(since.alias("a"), upto.alias("b")), lambda x: F.decode(F.substring(raw, x["a"] + 1, x["b"] - x["a"]), "UTF-8"))
    return tagged.withColumn(t, F.when(F.size(cuts) > 0, F.array_join(kept, "")).otherwise(F.col(t))).drop("hits").toDF(*names)
