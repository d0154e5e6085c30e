"""URL filter: host rules, then a logistic regression on hashed character n-grams.

Host and path are parsed by built-in expressions; the model scores host and path
bytes in Arrow batches. It is trained by the driver from a small labelled URL
table (a few hundred rows at most), whose sites are made up and shared with no
data, so the weights, one float for each of 2**BITS buckets, and a fitted bias
are all that tasks receive.

Up to FEW rules are matched by built-in expressions. Longer lists are a table
from host to its rules, in which each suffix of a url's host is looked up in the
same pass that scores: a url costs as many look-ups as its host has parts. The
list is the caller's, held by the driver and sent to the tasks as it is.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is allowed; of fitting rules of one length the last given wins;
repeated rows stay; an empty table gives an empty table; urls may be of any
length; other columns, whatever their names, are carried along except those
named host, path, rule, score or verdict, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import ddl, mapped, place, plainly
from sheaf.llm.words import buffers, mix, text_column

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Labelled URLs for the model, made up from words that such sites use: 1 is a page to block.
BLOCKED = (
    "http://online-casino-bonus.test/play/17", "https://www.royalcasino.test/en/408?id=4", "http://casino-jackpots.invalid/en/spin", "https://lucky-casino.test/fr/204",
    "http://poker-roulette.test/tables/3", "https://vip-slots.invalid/en/1520.html", "http://jackpot-winner.test/de/36", "https://win-big-now.invalid/prize/88",
    "http://sports-betting-tips.test/odds", "https://bets-online.invalid/en/12", "http://free-betting-offers.test/signup", "https://bets365bonus.test/es/903",
    "http://pills-online.test/order/cheap", "https://discount-pills.invalid/en/41", "http://cheap-meds.test/fr/7", "https://rx-pharmacy-cheap.invalid/cialis?qty=90",
    "http://buy-cheap-viagra.test/en/2277/", "https://weight-loss-pills.invalid/offer", "http://cheapest-replica.test/de/15", "https://cheap-handbags.invalid/outlet",
    "http://adult-chat.test/en/640", "https://xxx-videos.invalid/hot/8", "http://adults-only.test/fr/71#top", "https://www.adult-dating.invalid/join", "http://x-rated.test/gallery/52",
    "http://sex-cams.test/es/7", "https://hot-singles.invalid/near-you", "http://ads-server.test/banner/310", "https://adclick-tracker.invalid/en/28?page=2", "http://track-clicks.test/de/2",
    "https://popup-ads.invalid/fr/61", "http://tracking-pixel.test/px.gif", "http://spamblog.test/links/12", "https://spam-links.invalid/en/3", "http://link-farm.test/es/71.html",
    "https://content-farm.invalid/en/5105", "http://seo-spam.test/backlinks", "https://free-money-fast.invalid/44", "http://payday-loans.test/de/19", "https://crypto-doubler.invalid/send",
)
ALLOWED = (
    "http://www.city-library.test/catalogue/12", "https://news.daily-post.invalid/world/3", "http://blog.gardeners.test/spring/71.html", "https://weather-report.test/forecast/5/",
    "http://university.invalid/courses/88", "https://www.museum-guide.test/rooms/9?page=2", "http://history-notes.invalid/en/41", "https://m.recipes.test/soup/2",
    "http://open-data.invalid/tables/17", "https://town-council.test/minutes/204", "http://docs.software.invalid/manual/3.html", "https://maps.test/fr/99", "http://railway-times.invalid/de/7",
    "https://wiki.astronomy.test/stars/450", "http://school-board.invalid/calendar/32", "https://book-club.test/reviews/6", "http://physics-forum.invalid/thread/310", "https://www.film-archive.test/es/28",
    "http://music-lessons.invalid/piano/2", "https://science-weekly.test/fr/61", "http://health-service.invalid/advice/640", "https://m.travel-diary.test/de/52", "http://language-school.invalid/en/19",
    "https://hiking-trails.test/map/8", "http://farmers-market.invalid/stalls/44", "https://water-supply.test/en/71", "http://national-archive.invalid/fr/15", "https://public-radio.test/programme/3",
    "https://www.chess-club.invalid/games/825", "http://botanical-garden.test/de/474", "https://ocean-research.invalid/es/533", "http://village-hall.test/events/978", "http://mathematics.invalid/en/12",
    "https://the-herald.test/en/2201", "http://north-shore.invalid/fr/18", "https://then-and-now.test/de/33", "http://other-stories.invalid/en/501", "https://another-path.test/es/9", "http://winter-tales.invalid/en/64",
    "https://www.orchestra.test/season/4", "http://bicycle-repair.invalid/guide", "https://early-music.test/en/77.html", "http://river-watch.invalid/levels#top", "https://kitchen-notes.test/fr/8?ref=x", "http://parents-forum.invalid/en/3056",
    "https://blog.theatre.test/en/4110", "http://station.invalid/de/2718/", "https://nation-atlas.test/fr/612", "http://tradition.invalid/en/835?page=2", "https://m.rhythm.test/en/9001", "http://thread-and-thimble.invalid/es/41",
    "https://threshold.test/en/1200#top", "http://www.heathland.invalid/fr/6604", "https://thorn-hill.test/de/87.html", "http://shetland.invalid/en/5120/", "https://theory.test/en/640", "http://method.invalid/fr/229",
    "https://notion.test/de/3?utm_source=feed", "http://www.edition.invalid/en/7111", "https://birthday-cards.test/es/350",
)

SIZES, BITS = (3, 4, 5), 14
#: Rules that are matched by expressions; more are looked up.
FEW = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _buckets(col: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of each string, with one start mark before it."""
    at, data = buffers(col)
    size = np.diff(at) + 1
    first = np.concatenate([[0], np.cumsum(size)])
    buf = np.zeros(first[-1], np.uint64)
    body = np.ones(first[-1], bool)
    body[first[:-1]] = False
    buf[body] = data[at[0] : at[-1]]
    rows = np.repeat(np.arange(len(size)), size)
    out_rows, out = [], []
    for n in SIZES:
        if len(buf) < n:
            continue
        h = np.zeros(len(buf) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + buf[k : len(buf) - n + 1 + k]
        same = rows[: len(h)] == rows[n - 1 :]
        out_rows.append(rows[: len(h)][same])
        out.append((mix(h[same], salt * 8 + n) >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(out_rows), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): counts over the root of a row's number of n-grams."""
    parts = [_buckets(host, 1), _buckets(path, 2)]
    rows, buckets = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    total = np.bincount(rows, minlength=len(host))
    return rows, buckets, 1 / np.sqrt(np.maximum(total, 1))[rows]


class Model:
    """Weights of the n-gram buckets and the bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        rows, buckets, values = _features(host, path)
        z = np.bincount(rows, weights=self.weights[buckets] * values, minlength=len(host)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def parts(url: str) -> tuple[str, str]:
    """(host, path) of a URL in Python, as host_of and path_of give them."""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    stop = min([rest.find(c, end) for c in "?#" if rest.find(c, end) >= 0], default=len(rest))
    return rest[:end].translate(str.maketrans(_UPPER, _LOWER)), rest[end:stop]


def train(blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, steps: int = 3000, rate: float = 2.0, ridge: float = 1e-4) -> Model:
    """Logistic regression by full gradient steps over the labelled URLs; the bias is fitted without a ridge."""
    pairs = [parts(u) for u in (*blocked, *allowed)]
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    rows, buckets, values = _features(pa.array([h for h, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = np.bincount(rows, weights=w[buckets] * values, minlength=len(y)) + b
        off = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(buckets, weights=off[rows] * values, minlength=len(w)) / len(y) + ridge * w)
        b -= rate * off.mean()
    return Model(w, b)


class Rules:
    """Host to its rules, longest first, for lists too long for expressions."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.of: dict[str, list[tuple[int, int, str, str]]] = {}
        for k, (h, p, v) in enumerate(rules):
            self.of.setdefault(h, []).append((len(h + p), k, p, v))
        for own in self.of.values():
            own.sort(reverse=True)

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        at = 0
        while True:
            suffix = host[at:]
            for size, k, p, v in self.of.get(suffix, ()):
                if path.startswith(p):
                    best = max(best, (size, k, suffix + p, v))
                    break
            at = host.find(".", at) + 1
            if not at:
                return best[2], best[3]


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: Model | None = None, limit: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score (of blocking, by the model) and verdict ("allow" or "block")."""
    context = pages.sparkSession.sparkContext
    held = context.broadcast(model or train())
    many = context.broadcast(Rules(rules)) if len(rules) > FEW else None
    new = ["host", "path", "rule", "score", "verdict"]
    named, names = plainly(pages, new)
    u = place(names, url)
    base = named.withColumns({"host": host_of(F.col(u)), "path": path_of(F.col(u))})
    out_names = [*base.columns, "score", "rule", "said"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = text_column(batch, "host"), text_column(batch, "path")
            found = [many.value.rule(h, p) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)] if many else [(None, None)] * len(batch)
            said = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(host, path), pa.float64()), *said], names=out_names)

    scored = mapped(base, run, ddl(base.schema) + ", score double, rule string, said string")
    rule, verdict = (F.col("rule"), F.col("said")) if many else rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("score") >= limit) & (F.col("host") != ""), "block").otherwise("allow")
    scored = scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})
    return scored.select(*named.columns, *new).toDF(*names, *new)
