"""Near-duplicate documents: banded min-hashing with sequential Bayesian verification.

1. One pass gives each text's set of word shingles a size, a 128-bit print,
   BANDS band hashes and a signature of BANDS * ROWS bytes. Texts with the same
   set are one node from here on, named by their smallest id.
2. Nodes of a bucket (equal band hash) are compared with its leader, not with
   each other. The leader is the node that shares buckets with most others: in
   a group of copies the original, or what is closest to it. A node is first
   compared with the leader that it meets in most bands.
3. A comparison looks at the signatures batch by batch and gives up as soon as
   the posterior of the similarity (uniform prior) leaves less than MISS for
   its being large enough. Survivors are verified on their full shingle sets:
   texts are dealt by leader in blocks of about BLOCK candidates, each with the
   leader's text once, before theirs.
4. Components are formed. Only buckets that still hold several components go
   on: their nodes are compared with the leader exactly. What is left open are
   pairs of a node outside the leader's component with one of another
   component. Near the leader, both must share most of the second one's
   differences from the leader, so they meet in a join on its rarest ones. Nodes
   far from their leader, and those that the triangle inequality (Jaccard
   distance is a metric) lets be similar to one, meet in a join on the rarest
   shingles of their sets, of which similar sets share one; one bit of each
   signature byte, bounded in the same way, decides there which meet. No pair
   of a bucket is left open, no bucket's pairs are listed, and a bucket of n
   copies costs about n comparisons.

A pair with similarity 0.8 shares no bucket with probability
(1 - 0.8**ROWS)**BANDS, about 1e-7; that and MISS are all that can lose a link.

Joins on a bucket, print, leader or shingle are between written tables, one of
them with a row for each key, so that Spark splits them where a key is hot.
Such a table is broadcast only where its counted size is at most
BROADCAST_BYTES; otherwise the same join is a shuffle.

Defined results: null and empty texts have size 0 and stand alone; a text with
fewer words than a shingle is one shingle; rows with the same doc_id and
different texts count as linked; rows without a doc_id are not linked and not
kept; an empty table gives an empty table; texts may be of any length; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.batches import mapped, place, plainly
from sheaf.llm.components import components
from sheaf.llm.scratch import discard, stash
from sheaf.llm.words import LOWER_ASCII, NOT_SPACE, Run, mix, range_hashes, runs, text_column, window_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS, BATCH, MISS = 40, 5, 40, 1e-9
BROADCAST_BYTES = 16_000_000
#: Candidates that are dealt with one copy of their leader's text.
BLOCK = 128
#: Texts whose common shingles, at most so many, come last in the order of shingles.
ORDERED, COMMON = 500, 100_000
#: Similarity to a leader from which a node's differences from it are listed.
NEAR = 0.4

#: Texts in a run and bits of a shingle's hash fill 64 bits.
_TEXT_BITS = 10
_HASH_BITS = 64 - _TEXT_BITS

#: One bit of each signature byte, in four numbers.
_BITS = [f"bits_{k}" for k in range(4)]

_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(run: Run, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text in the run, 64-bit hash) of every shingle; texts with fewer words give their whole sequence."""
    h, first = run.hashes(), run.first
    w = window_hashes(h, size)
    owner = run.doc_of_word()[: len(w)]
    inside = np.arange(len(w)) + size <= first[owner + 1]
    count = run.counts()
    short = np.flatnonzero((count > 0) & (count < size))
    return np.concatenate([owner[inside], short]), np.concatenate([w[inside], range_hashes(h, first[short], first[short + 1], 1)])


def elements(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text."""
    for run in runs(col, NOT_SPACE, LOWER_ASCII):
        owner, h = shingles(run, size)
        order = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[order], np.arange(len(run.first)))
        for i in range(len(run.first) - 1):
            yield np.unique(h[order[at[i] : at[i + 1]]])


def _prints(col: pa.Array, size: int) -> list[pa.Array]:
    """n, fp, sig, bands of each text."""
    n_texts = len(col)
    n = np.zeros(n_texts, np.int64)
    prints = np.zeros((n_texts, 2), np.uint64)
    sig = np.zeros((n_texts, BANDS * ROWS), np.uint8)
    bands = np.zeros((n_texts, BANDS), np.uint64)
    for part in range(0, n_texts, 1 << _TEXT_BITS):
        for run in runs(col.slice(part, 1 << _TEXT_BITS), NOT_SPACE, LOWER_ASCII):
            owner, h = shingles(run, size)
            if not len(h):
                continue
            key = np.sort((owner.astype(np.uint64) << np.uint64(_HASH_BITS)) | (h >> np.uint64(_TEXT_BITS)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            owner = (key >> np.uint64(_HASH_BITS)).astype(np.int64)
            element = mix(key & np.uint64((1 << _HASH_BITS) - 1))
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rows = part + run.rows.start + owner[first]
            n[rows] = np.diff(np.append(first, len(owner)))
            prints[rows, 0] = np.add.reduceat(mix(element, 1), first)
            prints[rows, 1] = np.add.reduceat(mix(element, 2), first)
            low = (element >> np.uint64(32)).astype(np.uint32)
            band = np.zeros(len(rows), np.uint64)
            for k in range(BANDS * ROWS):
                least = np.minimum.reduceat(low * _MUL[k] + _ADD[k], first)
                sig[rows, k] = (least & np.uint32(0xFF)).astype(np.uint8)
                band = mix(band + least.astype(np.uint64), k)
                if k % ROWS == ROWS - 1:
                    bands[rows, k // ROWS] = band
                    band = np.zeros(len(rows), np.uint64)
    full = n > 0
    at = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
    return [
        pa.array(n, pa.int64()),
        pa.array([p.tobytes() if f else None for p, f in zip(prints, full.tolist(), strict=True)], pa.binary()),
        pa.array([s.tobytes() if f else None for s, f in zip(sig, full.tolist(), strict=True)], pa.binary()),
        pa.ListArray.from_arrays(pa.array(at), pa.array(bands[full].ravel().view(np.int64))),
    ]


def _tails(n: int, rates: np.ndarray) -> np.ndarray:
    """[rate, m]: the posterior that the match rate is at least this after m matches in n."""
    k = np.arange(n + 2)
    ways = np.array([lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) for i in k])
    x = np.clip(rates, 1e-12, 1 - 1e-12)[:, None]
    return np.cumsum(np.exp(ways + k * np.log(x) + (n + 1 - k) * np.log1p(-x)), axis=1)[:, : n + 1]


def _rate(similarity: float) -> float:
    """The rate at which signature bytes match, those that match by chance included."""
    return similarity + (1 - similarity) / 256


def least_matches(n: int, similarity: float, miss: float = MISS) -> int:
    """The fewest matches in n with which similarity is not ruled out."""
    return int(np.argmax(_tails(n, np.array([_rate(similarity)]))[0] >= miss))


def least_bits(similarity: float, miss: float = MISS) -> int:
    """The fewest equal bits, one of each signature byte, with which similarity is not ruled out."""
    return int(np.argmax(_tails(BANDS * ROWS, np.array([similarity + (1 - similarity) / 2]))[0] >= miss))


def bounds(miss: float = MISS) -> list[tuple[float, float]]:
    """For each number of matches of a whole signature: what the similarity is not below and not above, but for miss."""
    steps = np.linspace(0, 1, 401)
    tails = _tails(BANDS * ROWS, steps)
    low = (np.where(1 - tails < miss, steps[:, None], 0.0)).max(0)
    high = (np.where(tails < miss, steps[:, None], 1.0)).min(0)
    return [(max(0.0, float(x) - 1 / 256), float(y)) for x, y in zip(low, high, strict=True)]


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it was measured to be small."""
    long = [F.length(F.coalesce(F.col(f.name).cast("string"), F.lit(""))) for f in table.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum(long, F.lit(16 * len(table.columns)))
    return F.broadcast(table) if (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else table


class _Search:
    def __init__(self, docs: DataFrame, text: str, doc_id: str, size: int, similarity: float) -> None:
        self.size, self.similarity, self.percent = size, similarity, round(similarity * 100)
        named, names = plainly(docs)
        self.docs = named.select(F.col(place(names, doc_id)).alias("id"), F.col(place(names, text)).alias("text"))
        self.kind = self.docs.schema["id"].dataType.simpleString()

    def sets(self) -> DataFrame:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_prints(text_column(batch, "text"), size)], names=["id", "n", "fp", "sig", "bands"])

        return stash(mapped(self.docs, run, f"id {self.kind}, n long, fp binary, sig binary, bands array<long>"), "sets")

    def compared(self, pairs: DataFrame, sigs: DataFrame, whole: bool = False) -> DataFrame:
        """pairs (a, b, ...) with matches (in the batches looked at; in all of them if whole) and alive."""
        names = pairs.columns
        joined = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        joined = joined.select(*names, "sig_a", "sig_b")
        width = BANDS * ROWS
        need = [(n, least_matches(n, self.similarity)) for n in range(BATCH, width + 1, BATCH)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), width) for k in (len(names), len(names) + 1))
                matches = np.zeros(len(batch), np.int64)
                alive = np.arange(len(batch))
                for n, least in need:
                    matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
                    alive = alive[matches[alive] >= least]
                ok = np.zeros(len(batch), bool)
                ok[alive] = True
                if whole:
                    matches = (a == b).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(matches, pa.int64()), pa.array(ok)], names=[*names, "matches", "alive"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
        return mapped(joined, run, f"{schema}, matches long, alive boolean")

    def _texts(self, ids: DataFrame) -> DataFrame:
        """Documents (id, text) whose ids are in a written table."""
        return self.docs.join(_few(ids), "id", "left_semi")

    def _dealt(self, pairs: DataFrame) -> DataFrame:
        """Texts of pairs (a, b), written before: sorted rows b, block, a, text; in each block those of the leader b (a is null) first."""
        ids = stash(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        leaders = stash(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "leaders")
        texts, led = self._texts(ids), _few(leaders)
        asked = pairs.select("a", "b").join(led, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
        theirs = texts.join(asked, F.col("id") == F.col("a")).select("b", "block", "a", "text")
        own = leaders.select("b", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
        own = texts.join(own, F.col("id") == F.col("b")).select("b", "block", F.lit(None).cast(self.kind).alias("a"), "text")
        return own.unionByName(theirs).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").isNotNull())

    def differences(self, pairs: DataFrame, listed: bool = True) -> DataFrame:
        """pairs (a, b), written before, with their exact similarity, whether it suffices, and what of a differs from b.

        missing and added are the elements of b that a lacks and of a that b
        lacks; they are left out (null) where the similarity is below NEAR, and
        if not listed.
        """
        size, least = self.size, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, leaders = None, []
            for batch in batches:
                b, no, a = (batch.column(k).to_pylist() for k in range(3))
                at: list[int] = []
                out: list[list] = [[], [], [], [], []]
                for k, x in enumerate(elements(text_column(batch, "text"), size)):
                    if block != (b[k], no[k]):
                        block, leaders = (b[k], no[k]), []
                    if a[k] is None:
                        leaders.append(x)
                        continue
                    for y in leaders:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        total = len(x) + len(y) - common
                        near = listed and common >= NEAR * total
                        at.append(k)
                        out[0].append(common / max(1, total))
                        out[1].append(common > 0 and 100 * common >= least * total)
                        out[2].append(np.setdiff1d(y, x, assume_unique=True).view(np.int64).tolist() if near else None)
                        out[3].append(np.setdiff1d(x, y, assume_unique=True).view(np.int64).tolist() if near else None)
                        out[4].append(len(y))
                kinds = (pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(2).take(taken), batch.column(0).take(taken), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["a", "b", "j", "linked", "missing", "added", "n_leader"])

        return mapped(self._dealt(pairs), run, f"a {self.kind}, b {self.kind}, j double, linked boolean, missing array<long>, added array<long>, n_leader long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), written before, whose shingle sets are similar enough."""
        return self.differences(pairs, listed=False).where("linked").select("a", "b").distinct()

    def components(self) -> tuple[DataFrame, DataFrame]:
        """(id, node) of the documents that share their set with a smaller id or are named twice, and (id, component) of the linked nodes."""
        sets = self.sizes = self.sets()
        own = sets.where((F.col("n") > 0) & F.col("id").isNotNull())
        copied = stash(own.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")).where("n > 1").select("fp", "node"), "copied")
        twins = stash(own.select("id", "fp").join(_few(copied), "fp").where(F.col("id") != F.col("node")).select("id", "fp", "node"), "twins")
        nodes = own.join(_few(twins.select("id", "fp")), ["id", "fp"], "left_anti")
        sigs = nodes.select("id", "sig")
        named, same = self._named_twice(own, copied, twins)

        rows = nodes.select("id", F.explode("bands").alias("bucket"))
        shared = stash(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), "shared")
        met = stash(rows.join(_few(shared), "bucket").select("bucket", "id", "n"), "met")
        central = stash(met.groupBy("id").agg(F.sum("n").alias("weight")), "central")
        weighed = met.join(_few(central), "id")
        leaders = stash(weighed.groupBy("bucket").agg(F.max_by("id", F.struct("weight", "id")).alias("leader")), "leaders")
        members = stash(met.join(_few(leaders), "bucket").select("bucket", "id", "leader"), "members")
        discard(shared, met, central, leaders)

        # Each node with the leader it meets most.
        meets = members.where(F.col("id") != F.col("leader")).groupBy("id", "leader").agg(F.count("*").alias("n"))
        best = meets.groupBy("id").agg(F.max_by("leader", F.struct("n", "leader")).alias("b"))
        first = stash(self.compared(best.select(F.col("id").alias("a"), "b"), sigs).where("alive").select("a", "b"), "pairs")
        links = stash(self.verified(first).unionByName(same), "links")
        component = components(links)

        # Buckets with several components: all their nodes with the leader.
        now = members.join(_few(component), "id", "left").select("bucket", "id", "leader", F.coalesce("component", "id").alias("component"))
        mixed = stash(now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y")).select("bucket"), "mixed")
        still = stash(now.join(_few(mixed), "bucket", "left_semi"), "still")
        discard(mixed, members, first)
        if still.isEmpty():
            return named, component
        head = still.where(F.col("id") == F.col("leader")).select("bucket", F.col("component").alias("led"))
        pairs = still.where(F.col("id") != F.col("leader")).join(head, "bucket").groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.max(F.col("component") != F.col("led")).alias("apart"))
        against = stash(self.compared(pairs, sigs, whole=True), "against")
        table = bounds()
        low, high = (F.get(F.array(*[F.lit(float(x[k])) for x in table]), F.col("matches").cast("int")) for k in (0, 1))
        maybe = stash(against.where(high >= NEAR).select("a", "b"), "pairs")
        exact = stash(self.differences(maybe), "differences")
        new = exact.where("linked").join(against.where("apart"), ["a", "b"], "left_semi").select("a", "b")
        links = stash(links.unionByName(new), "links")
        component = components(links)

        # Nodes outside the leader's component (u) with nodes of other components.
        few = _few(component)
        of = lambda df, node, name: df.join(few.select(F.col("id").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
        placed = of(of(exact, "a", "component"), "b", "led")
        left = self._by_differences(placed).unionByName(self._by_shingles(still, against, exact, sigs, of, low, high)).distinct()
        third = stash(self.compared(left, sigs).where("alive").select("a", "b"), "pairs")
        discard(still, against, maybe, exact)
        if not third.isEmpty():
            component = components(links.unionByName(self.verified(third)))
        return named, component

    def _named_twice(self, own: DataFrame, copied: DataFrame, twins: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, node) of documents that are no node of their own, and links between the nodes of ids with several texts."""
        again = stash(own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
        named = twins.select("id", "node")
        if again.isEmpty():
            return named, named.select(F.col("node").alias("a"), F.col("id").alias("b")).limit(0)
        of = own.select("id", "fp").join(_few(again), "id", "left_semi").join(_few(copied), "fp", "left").select("id", F.coalesce("node", "id").alias("node")).distinct()
        least = of.groupBy("id").agg(F.min("node").alias("a"))
        return named, of.join(least, "id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()

    def _by_differences(self, placed: DataFrame) -> DataFrame:
        """Pairs of nodes near a common leader that can be similar though one of them (u) is not similar to the leader.

        Let u lack r of the leader's n elements and add a, let y lack r' and add
        a', and s = 1 / (1 + similarity). The two are similar exactly if they
        share o = w + w' - (2 s - 1) n of these differences or more, where
        w = s r + (1 - s) a; u, not being similar to the leader, has
        w > (2 s - 1) n. In one order of all differences, rarest first, the
        first that both share is among the first (all - o + 1) of either, so
        pairs meet in a join on it.
        """
        near = placed.where(F.col("missing").isNotNull())
        s = 1 / (1 + self.similarity)
        weight = s * F.size("missing") + (1 - s) * F.size("added")
        tagged = F.concat(F.transform("missing", lambda x: F.struct(F.lit(0).alias("side"), x.alias("x"))), F.transform("added", lambda x: F.struct(F.lit(1).alias("side"), x.alias("x"))))
        size = (F.size("missing") + F.size("added")).alias("size")
        rows = near.select("a", "b", "component", (F.col("component") != F.col("led")).alias("outside"), weight.alias("w"), (weight - (2 * s - 1) * F.col("n_leader")).alias("lack"), size, F.explode(tagged).alias("d"))
        rows = stash(rows.select("a", "b", "component", "outside", "w", "lack", "size", "d.side", "d.x"), "elements")
        often = stash(rows.where("outside").groupBy("b", "side", "x").agg(F.count("*").alias("n")), "often")
        ranked = rows.join(_few(often), ["b", "side", "x"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("b", "a").orderBy(F.coalesce("n", F.lit(0)), "side", "x")))
        ranked = stash(ranked.where((F.col("nth") <= F.col("size") - F.ceil(F.col("w") - 1e-9) + 1) & F.col("n").isNotNull() | F.col("outside")), "ranked")
        asked = ranked.where("outside").select("b", "side", "x", F.col("a").alias("u"), F.col("component").alias("of_u"), F.col("lack").alias("u_lack"), F.col("size").alias("u_size"), F.col("nth").alias("u_nth"))
        shared = F.ceil(F.col("w") + F.col("u_lack") - 1e-9)
        both = (F.col("component") != F.col("of_u")) & (F.col("nth") <= F.col("size") - shared + 1) & (F.col("u_nth") <= F.col("u_size") - shared + 1)
        met = ranked.select("b", "side", "x", "a", "component", "w", "size", "nth").join(asked, ["b", "side", "x"]).where(both)
        return met.select(F.greatest("a", "u").alias("a"), F.least("a", "u").alias("b"))

    def _by_shingles(self, still: DataFrame, against: DataFrame, exact: DataFrame, sigs: DataFrame, of, low: Column, high: Column) -> DataFrame:
        """Pairs of a node far from its leader with any node that the triangle inequality lets be similar to a far one of its bucket.

        Two sets of n and n' elements are similar only if they share
        o = s / (1 + s) (n + n') elements or more; in one order of all
        elements, rarest first, the first that both share is among the first
        n - o + 1 of the one and n' - o + 1 of the other.
        """
        known = exact.select("a", "b", "j", F.col("missing").isNotNull().alias("near"))
        seen = against.select("a", "b", low.alias("low"), high.alias("high")).join(known, ["a", "b"], "left")
        seen = seen.select(F.col("a").alias("id"), F.col("b").alias("leader"), F.coalesce("j", "low").alias("low"), F.coalesce("j", "high").alias("high"), F.coalesce("near", F.lit(False)).alias("near"))
        rest = stash(still.select("bucket", "id", "leader").join(seen, ["id", "leader"]).select("bucket", "id", "low", "high", "near"), "rest")
        tops = stash(rest.where(~F.col("near")).groupBy("bucket").agg(F.max("high").alias("top")), "tops")
        near_enough = F.col("low") <= F.col("top") + 1 - self.similarity + 1e-9
        placed = stash(of(rest.join(_few(tops), "bucket").where(near_enough).select("bucket", "id", "near"), "id", "component"), "placed")
        several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y")).select("bucket")
        placed = placed.join(_few(stash(several, "several")), "bucket", "left_semi")  # in others all are linked by now
        asked = stash(placed.groupBy("id", "component").agg(F.max(~F.col("near")).alias("far")), "asked")
        size, percent = self.size, self.percent
        texts = self._texts(asked.select("id")).join(sigs.join(_few(asked.select("id")), "id", "left_semi"), "id").select("id", "text", "sig")
        held = self.docs.sparkSession.sparkContext.broadcast(self._common(texts, asked.count()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, often = held.value
            for batch in batches:
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), BANDS * ROWS)
                packed = np.zeros((len(batch), 32), np.uint8)
                packed[:, : BANDS * ROWS // 8] = np.packbits(sig & 1, axis=1)
                bits = packed.view(np.int64)
                row, n, x, nth = ([np.zeros(0, np.int64)] for _ in range(4))
                for k, own in enumerate(elements(text_column(batch, "text"), size)):
                    own = own.view(np.int64)
                    at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
                    known = np.where(common[at] == own, often[at], 0) if len(common) else np.zeros(len(own), np.int64)
                    first = own[np.lexsort((own, known))][: len(own) + (-len(own) * percent // 100) + 1]
                    row.append(np.full(len(first), k))
                    n.append(np.full(len(first), len(own)))
                    x.append(first)
                    nth.append(np.arange(1, len(first) + 1))
                of = np.concatenate(row)
                numbers = [pa.array(np.concatenate(v)) for v in (n, x, nth)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *numbers, *(pa.array(np.ascontiguousarray(bits[of, k])) for k in range(4))], names=["id", "n", "x", "nth", *_BITS])

        first = mapped(texts, run, f"id {self.kind}, n long, x long, nth long, {', '.join(f'{b} long' for b in _BITS)}")
        ranked = stash(first.join(_few(asked), "id"), "far-ranked")
        u = ranked.where("far").select("x", F.col("id").alias("u"), F.col("component").alias("of_u"), F.col("n").alias("n_u"), F.col("nth").alias("nth_u"), *[F.col(b).alias(f"{b}_u") for b in _BITS])
        shared = F.ceil((F.col("n") + F.col("n_u")) * (self.percent / (100 + self.percent)) - 1e-9)
        both = (F.col("component") != F.col("of_u")) & (F.col("nth") <= F.col("n") - shared + 1) & (F.col("nth_u") <= F.col("n_u") - shared + 1)
        once = ~F.col("far") | (F.col("id") < F.col("u"))
        differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_u"))) for b in _BITS), F.lit(0))
        met = ranked.join(u, "x").where(both & once & (differ <= BANDS * ROWS - least_bits(self.similarity)))
        return met.select(F.greatest("u", "id").alias("a"), F.least("u", "id").alias("b"))


    def _common(self, texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles that several of about ORDERED of the n texts share, sorted, and how many do.

        They only fix an order, common shingles last, and any order gives the
        same pairs; so a few texts are enough, and at most COMMON shingles.
        """
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.concatenate([np.zeros(0, np.uint64), *elements(text_column(batch, "text"), size)]).view(np.int64)
                x, often = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(often.astype(np.int64))], names=["x", "n"])

        some = texts.select("id", "text").where(F.xxhash64("id") / F.lit(2.0**64) + 0.5 < ORDERED / max(n, 1))
        table = mapped(some, run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "x").limit(COMMON).toArrow()
        x, often = (table.column(k).to_numpy() for k in range(2))
        order = np.argsort(x)
        return x[order], often[order]


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest linked doc_id) and kept (it is that one)."""
    search = _Search(docs, text, doc_id, size, similarity)
    named, component = search.components()
    of_copies = named.join(component.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("component", "node").alias("component_id"))
    own = component.select("id", F.col("component").alias("component_id"))
    first = stash(of_copies.unionByName(own).groupBy("id").agg(F.min("component_id").alias("component_id")), "component-of")
    sets = search.sizes
    joined = sets.join(_few(first), "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with the same columns, with one document of each group of near-duplicates.

    The one with the smallest doc_id stays; of rows that repeat an id, one.
    Rows without a doc_id stay.
    """
    named, names = plainly(docs)
    i = place(names, doc_id)
    kept = stash(near_duplicates(docs, text, doc_id, size, similarity).where("kept").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    out = named.join(_few(kept), named[i] == kept["doc_id"], "left").where(F.col("doc_id").isNotNull() | F.col(i).isNull())
    if kept.where("n > 1").isEmpty():
        return out.select(*named.columns).toDF(*names)
    numbered = stash(out.withColumn("row", F.monotonically_increasing_id()), "kept-rows")
    one = numbered.where(F.col("n") > 1).groupBy("doc_id").agg(F.min("row").alias("row")).select("row")
    single = numbered.where(F.col("doc_id").isNull() | (F.col("n") == 1))
    return single.unionByName(numbered.join(one, "row", "left_semi").select(*numbered.columns)).select(*named.columns).toDF(*names)
