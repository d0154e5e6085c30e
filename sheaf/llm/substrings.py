"""Exact removal of repeated passages: a compacted de Bruijn graph of token k-mers.

An edge of the graph is a window of SIZE consecutive words, from the node of its
first SIZE - 1 words to that of its last. Only edges that the corpus holds more
than once matter, and those are found without listing all edges:

1. Texts are numbered and written. A pass over them gives pieces: runs of
   consecutive windows of a text that share their minimiser, the window's k-mer
   of ANCHOR words with the least hash. Equal windows have the same minimiser
   at the same place, so a piece (minimiser, content) is a path that is already
   compacted as far as one text shows. Pieces equal within a batch are summed.
2. Minimisers found more than once stay. A content found more than once is a
   repeated path; where a minimiser has several contents, paths branch inside
   of pieces, and the windows of each content are compared singly.
3. One source place of each repeated path and window is read again. It gives
   the end nodes, the first and last edge, and a digest of the words.
4. Compaction. Spark aggregates the edges that lead into and out of each end
   node. Where one edge comes in and one goes out, the paths that meet are one:
   along their source text by place, and between sources by a join on the node,
   after which connected paths get one name (alternating stars).
5. Source coordinates verify: each occurrence is read in its own text, and its
   words must have the digest of the words at the source. Verified occurrences
   are glued to maximal spans, each with the name of its path, and the words
   they cover are removed.

Pieces and windows are found by 128 bits of hashes and verified by 128 bits of
BLAKE2b over their words. A passage would be missed
only if the hashes of different passages collided; none is removed for it.

Joins are on keys with one row on one side, both sides written tables where a
key can be hot, so that Spark splits them; a content occurs in a join once a
batch at most. Tables are broadcast only if their counted size is at most
BROADCAST_BYTES; otherwise the same join is a shuffle.

Defined results: null and empty texts have no words; a text shorter than a
window loses nothing; all copies of a passage lose it, the first as well; rows
that repeat a doc_id, or have none, are texts of their own; an empty table gives
an empty table; texts may be of any length; other columns, whatever their names,
are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.batches import ddl, mapped, place, plainly
from sheaf.llm.components import components
from sheaf.llm.scratch import discard, stash
from sheaf.llm.words import NOT_SPACE, Run, mix, range_hashes, runs, text_column, window_hashes

SIZE, ANCHOR = 35, 8
BROADCAST_BYTES = 16_000_000

#: A place packs its first word and the number of windows less one.
_WINDOW_BITS = 6
#: Windows whose minimisers are sought at once.
_BLOCK = 1 << 22
_AT_BITS = 24
#: Salt of the hashes of nodes.
_NODE = 5


def _minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of each width consecutive k-mer hashes (by their upper bits)."""
    out = []
    for a in range(0, len(grams) - width + 1, _BLOCK):
        part = grams[a : a + _BLOCK + width - 1]
        m = (mix(part, 9) & ~np.uint64((1 << _AT_BITS) - 1)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if width > span:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        out.append((m & np.uint64((1 << _AT_BITS) - 1)).astype(np.int64) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pieces(h: np.ndarray, first: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """minimiser, content hash, text in the run, first word (from the run's start) and number of windows of each piece."""
    grams = window_hashes(h, anchor)
    places = _minimisers(grams, size - anchor + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(places)]
    valid = np.flatnonzero(np.arange(len(places)) + size <= first[owner + 1])
    if not len(valid):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    at = places[valid]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n, start = np.diff(np.append(new, len(valid))), valid[new]
    return grams[at[new]], range_hashes(h, start, start + n + size - 1, 3), owner[start], start, n


def _begin(at: Column) -> Column:
    return F.shiftright(at, _WINDOW_BITS).cast("int")


def _windows(at: Column) -> Column:
    return (at.bitwiseAND(F.lit((1 << _WINDOW_BITS) - 1)) + 1).cast("int")


def _glued(ranges: np.ndarray) -> np.ndarray:
    """Sorted [start, end) rows, merged where they touch or overlap."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    upto = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > upto[:-1]])
    return np.stack([r[new, 0], upto[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)]], axis=1)


def _split(run: Run, d: int) -> list[bytes]:
    """The words of text d of a run."""
    return run.buf[run.text_at[d] : run.text_at[d + 1]].tobytes().split()


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _few(table: DataFrame, width: int) -> DataFrame:
    """A written table of rows of some width, to be broadcast if they were counted to be few."""
    return F.broadcast(table) if table.count() * width <= BROADCAST_BYTES else table


_PLACE = pa.struct([("row", pa.int64()), ("at", pa.int64())])
_WINDOWS = "anchor long, content long, row long, start int, weight int"
_EDGES = "anchor long, content long, row long, start int, n int, head long, first long, tail long, last long, digest binary"


class _Graph:
    """Over numbered texts: a written table (row, text)."""

    def __init__(self, texts: DataFrame, size: int, anchor: int) -> None:
        if not 2 <= anchor < size <= anchor + (1 << _WINDOW_BITS):
            raise ValueError("a window must be longer than the k-mer of its minimiser, by 64 words at most")
        self.texts, self.size, self.anchor = texts, size, anchor

    def pieces(self) -> DataFrame:
        """A row for each content of a batch: its minimiser, count, first place and the other places."""
        size, anchor = self.size, self.anchor

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = batch.column(0).to_numpy()
                got: list[list[np.ndarray]] = [[], [], [], [], []]
                for r in runs(text_column(batch, "text"), NOT_SPACE):
                    a, c, owner, start, n = pieces(r.hashes(), r.first, size, anchor)
                    for k, x in enumerate((a, c, owner + r.rows.start, start - r.first[owner], n)):
                        got[k].append(x)
                a, c, row, start, n = (np.concatenate([np.zeros(0, np.int64) if k > 1 else np.zeros(0, np.uint64), *x]) for k, x in enumerate(got))
                order = np.lexsort((c, a))
                same = np.concatenate([[False], (a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])]) if len(order) else np.zeros(0, bool)
                heads = np.flatnonzero(~same)
                count = np.diff(np.append(heads, len(order)))
                keep = order[heads]
                row, at = number[row], (start << _WINDOW_BITS) | (n - 1)
                others = order[np.flatnonzero(same)]
                offsets = np.concatenate([[0], np.cumsum(count - 1)]).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(row[others]), pa.array(at[others])], fields=list(_PLACE)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[keep].view(np.int64)), pa.array(c[keep].view(np.int64)), pa.array(count, pa.int64()), pa.array(row[keep], pa.int64()), pa.array(at[keep], pa.int64()), more],
                    names=["anchor", "content", "count", "row", "at", "more"],
                )

        return mapped(self.texts, run, "anchor long, content long, count long, row long, at long, more array<struct<row:long,at:long>>")

    def met(self) -> tuple[DataFrame, DataFrame]:
        """Pieces whose minimiser is found more than once, and their contents (with the number found and a source) that repeat or branch."""
        every = self.pieces()
        touched = every.groupBy("anchor").agg(F.sum("count").alias("touched"), (F.min("content") != F.max("content")).alias("branches")).where(F.col("touched") > 1)
        touched = stash(touched.select("anchor", "branches"), "touched")
        met = stash(every.join(_few(touched, 24), "anchor"), "met")
        source = F.min(F.struct("row", "at")).alias("source")
        contents = met.groupBy("anchor", "content").agg(F.sum("count").alias("total"), source, F.max("branches").alias("branches"))
        contents = stash(contents.where((F.col("total") > 1) | F.col("branches")).select("anchor", "content", "total", "branches", "source.*"), "contents")
        discard(touched)
        return met, contents

    def _sources(self, places: DataFrame, name: str) -> DataFrame:
        """row, text and the list of places (structs of anchor, content, at, ...) asked of each text."""
        asked = stash(places.groupBy("row").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "row"])).alias("places")), name)
        rows = _few(asked.select("row"), 16)
        return self.texts.join(rows, "row", "left_semi").join(asked, "row").select("row", "text", "places")

    def windows(self, contents: DataFrame) -> DataFrame:
        """The windows of contents whose minimiser branches, read at their source: content is a window's hash, weight 1 or (if the content repeats) 2. Written out."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, asked = batch.column(0).to_numpy(), batch.column(2)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
                for r in runs(text_column(batch, "text"), NOT_SPACE):
                    w = window_hashes(r.hashes(), size).view(np.int64)
                    for d in range(r.rows.start, r.rows.stop):
                        x = asked[d].values
                        at = x.field("at").to_numpy()
                        begin, n = at >> _WINDOW_BITS, (at & ((1 << _WINDOW_BITS) - 1)) + 1
                        each = np.repeat(np.arange(len(at)), n)
                        p = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                        for k, v in enumerate((x.field("anchor").to_numpy()[each], w[r.first[d - r.rows.start] + p], np.full(len(p), number[d]), p, x.field("weight").to_numpy()[each])):
                            out[k].append(v)
                columns = [np.concatenate(x).astype(np.int32 if k > 2 else np.int64) for k, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["anchor", "content", "row", "start", "weight"])

        asked = contents.where("branches").select("row", "anchor", "at", F.least("total", F.lit(2)).cast("int").alias("weight"))
        return stash(mapped(self._sources(asked, "asked"), run, _WINDOWS), "windows")

    def edges(self, places: DataFrame) -> DataFrame:
        """Repeated contents and windows (anchor, content, row, at) with n, end nodes, first and last edge and digest, read at their source. Written out."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, asked = batch.column(0).to_numpy(), batch.column(2)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(9)]
                digests: list[bytes] = []
                for r in runs(text_column(batch, "text"), NOT_SPACE):
                    h = r.hashes()
                    w, nodes = window_hashes(h, size).view(np.int64), mix(window_hashes(h, size - 1), _NODE).view(np.int64)
                    for d in range(r.rows.start, r.rows.stop):
                        words, x = _split(r, d - r.rows.start), asked[d].values
                        at = x.field("at").to_numpy()
                        begin, n = at >> _WINDOW_BITS, (at & ((1 << _WINDOW_BITS) - 1)) + 1
                        p = r.first[d - r.rows.start] + begin
                        for k, v in enumerate((x.field("anchor").to_numpy(), x.field("content").to_numpy(), np.full(len(p), number[d]), begin, n, nodes[p], w[p], nodes[p + n], w[p + n - 1])):
                            out[k].append(v)
                        digests += [_digest(words[i : i + k]) for i, k in zip(begin.tolist(), (n + size - 1).tolist(), strict=True)]
                columns = [np.concatenate(x).astype(np.int32 if k in (3, 4) else np.int64) for k, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(digests, pa.binary())], names=["anchor", "content", "row", "start", "n", "head", "first", "tail", "last", "digest"])

        return stash(mapped(self._sources(places, "asked"), run, _EDGES), "edges")

    def paths(self, edges: DataFrame) -> DataFrame:
        """(anchor, content, path) of repeated paths and windows (edges, written: one row for each), compacted where no end node branches."""
        into = edges.groupBy(F.col("tail").alias("node")).agg((F.min("last") == F.max("last")).alias("one_in"))
        out = edges.groupBy(F.col("head").alias("node")).agg((F.min("first") == F.max("first")).alias("one_out"))
        through = stash(into.where("one_in").join(out.where("one_out"), "node").select("node"), "through")
        few = _few(through, 16)
        flagged = edges.join(few.select(F.col("node").alias("tail"), F.lit(True).alias("on")), "tail", "left")
        order = Window.partitionBy("row").orderBy("start", "n", "anchor")
        before = F.lag(F.struct((F.col("start") + F.col("n")).alias("upto"), F.col("on").isNotNull().alias("on"))).over(order)
        begins = ~F.coalesce((before["upto"] == F.col("start")) & before["on"], F.lit(False))
        chained = flagged.withColumn("begins", begins).withColumn("no", F.sum(F.col("begins").cast("int")).over(order))
        chained = stash(chained.select("anchor", "content", "head", "tail", F.xxhash64("row", "no").alias("chain")), "chains")
        ends = chained.join(few.select(F.col("node").alias("tail")), "tail", "left_semi").groupBy(F.col("tail").alias("node")).agg(F.min("chain").alias("a"))
        begun = chained.join(few.select(F.col("node").alias("head")), "head", "left_semi").select(F.col("head").alias("node"), F.col("chain").alias("b")).distinct()
        more = chained.join(few.select(F.col("node").alias("tail")), "tail", "left_semi").select(F.col("tail").alias("node"), F.col("chain").alias("b")).distinct()
        links = begun.unionByName(more).join(ends, "node").where(F.col("a") != F.col("b")).select("a", "b").distinct()
        named = components(links)
        out = chained.join(_few(named, 24).withColumnRenamed("id", "chain"), "chain", "left")
        return out.select("anchor", "content", F.coalesce("component", "chain").alias("path"))

    def occurrences(self) -> DataFrame:
        """(row, found): for each text with a repeated window, what was found in it: start, n (windows), path, digest. Not verified."""
        met, contents = self.met()
        windows = self.windows(contents)
        often = windows.groupBy("anchor", "content").agg(F.sum("weight").alias("found"), F.min(F.struct("row", "start")).alias("s")).where("found > 1")
        often = stash(often.select("anchor", "content", "s.row", F.shiftleft(F.col("s.start").cast("long"), _WINDOW_BITS).alias("at")), "often")
        edges = self.edges(contents.where("total > 1").select("row", "anchor", "content", "at").unionByName(often.select("row", "anchor", "content", "at")))
        path = self.paths(edges)
        # A content of one window has the hash of a content and that of a window, which differ: each row is of one kind.
        known = stash(edges.select("anchor", "content", "digest").join(path, ["anchor", "content"]).dropDuplicates(["anchor", "content"]), "known")
        few = _few(known, 56)
        places = F.explode(F.concat(F.array(F.struct("row", "at")), F.coalesce(F.col("more"), F.array().cast("array<struct<row:long,at:long>>")))).alias("p")
        wholly = met.select("anchor", "content", "row", "at", "more").join(few, ["anchor", "content"]).select("path", "digest", places)
        wholly = wholly.select("p.row", _begin(F.col("p.at")).alias("start"), _windows(F.col("p.at")).alias("n"), "path", "digest")
        hits = windows.where("weight = 1").join(few, ["anchor", "content"]).select("row", "start", F.lit(1).alias("n"), "path", "digest")
        found = wholly.unionByName(hits).groupBy("row").agg(F.collect_list(F.struct("start", "n", "path", "digest")).alias("found"))
        out = stash(found, "found")
        discard(met, contents, windows, often, edges, known)
        return out


def _passages(words: list[bytes], found: pa.StructArray, size: int) -> tuple[np.ndarray, list[dict]]:
    """Of a text's words: the covered ranges, and maximal verified spans with the name of their path."""
    ok = []
    for start, n, path, digest in sorted(zip(*(found.field(k).to_pylist() for k in range(4)), strict=True)):
        if _digest(words[start : start + n + size - 1]) == digest:
            ok.append((start, start + n + size - 1, path))
    spans: list[dict] = []
    for a, b, path in ok:
        if spans and spans[-1]["path"] == path and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(b, spans[-1]["end"])
        else:
            spans.append({"start": a, "end": b, "path": path})
    return _glued(np.array([[x["start"], x["end"]] for x in spans], np.int64).reshape(-1, 2)), spans


def without_repeats(docs: DataFrame, text: str = "text", size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """docs with kept (the words left, joined by a space), n_words, n_removed, removed (word ranges) and passages.

    passages: the repeated passages of a text, each as its word range and the
    number of its path in the graph, which is the same wherever it occurs.
    Columns of docs with these names are replaced.
    """
    new = ["kept", "n_words", "n_removed", "removed", "passages"]
    named, names = plainly(docs, new)
    t = place(names, text)
    numbered = stash(named.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = _Graph(numbered.select("row", F.col(t).alias("text")), size, anchor).occurrences()
    carried = named.columns
    out_ddl = ddl(named.schema) + ", kept string, n_words long, n_removed long, removed array<struct<start:int,end:int>>, passages array<struct<start:int,end:int,path:long>>"
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("path", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("found") if "found" in batch.schema.names else None
            for r in runs(text_column(batch, t), NOT_SPACE):
                out: list[list] = [[], [], [], [], []]
                for d in range(r.rows.stop - r.rows.start):
                    words = _split(r, d)
                    here = asked[r.rows.start + d].values if asked is not None else None
                    ranges, spans = _passages(words, here, size) if here is not None else (np.zeros((0, 2), np.int64), [])
                    pairs, left, upto = ranges.tolist(), [], 0
                    for x, y in pairs:
                        left += words[upto:x]
                        upto = y
                    removed = [{"start": x, "end": y} for x, y in pairs]
                    for k, v in enumerate((b" ".join(left + words[upto:] if pairs else words).decode(), len(words), sum(y - x for x, y in pairs), removed, spans)):
                        out[k].append(v)
                part = batch.slice(r.rows.start, r.rows.stop - r.rows.start)
                kinds = (pa.string(), pa.int64(), pa.int64(), pair, passage)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=[*carried, *new])

    rows = found.select("row")
    if found.count() * 16 <= BROADCAST_BYTES:  # the texts that lose nothing need no shuffle
        rows = F.broadcast(rows)
        without = numbered.join(rows, "row", "left_anti").select(*carried)
        some = numbered.join(rows, "row", "left_semi").join(found, "row").select(*carried, "found")
        out = mapped(without, run, out_ddl).unionByName(mapped(some, run, out_ddl))
    else:
        out = mapped(numbered.join(found, "row", "left").select(*carried, "found"), run, out_ddl)
    return out.toDF(*names, *new)
