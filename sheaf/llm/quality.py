"""Host-level quality rules, with DataFrame functions only.

Each document is measured by itself and fails or passes each of RULES: the base
rules (too short, or repeating itself), a share of symbols, and lines that equal
earlier ones. Failures are counted by host and rule. For each rule a beta prior
is fitted to the hosts' rates (method of moments), which shrinks the rate of a
host the more the fewer documents it has. A host is rejected if, for some rule,
its rate is, SURE posterior standard deviations below the shrunk mean, still
more than halfway from the prior's mean to failing always. So a host is judged
against what hosts are like, and a few documents reject no host. The verdict is
joined back to the host's documents: all of them go.

Measuring is one pass without a shuffle whose rows, without the texts, are
written to the checkpoint folder, as both the counts and the result need them.
Counts are summed before the shuffle, so a host with most of all documents is
no heavier than any other; the join back is on the hosts' table, which Spark
broadcasts only if it is small and otherwise splits where a host is too large.

Repeated windows are found by sorting packed 64-bit values (33 bits of a hash
above, position below) and those that agree are compared by their full 64-bit
hashes; a text of any length that Spark holds is packed the same way.

Defined results: null text has no words and fails; a null host is a host of
its own; repeated rows are documents of their own; an empty table gives an empty
table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import place, plainly
from sheaf.llm.scratch import stash

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3
#: The part of the way from the prior's mean to 1 over which a host's rate is too high, and how sure that must be, in standard deviations.
PART, SURE = 0.5, 3.0
#: Symbols for a hundred characters of words, and words for each line that equals an earlier one.
SYMBOL_PERCENT, WORDS_A_REPEATED_LINE = 10, 20
RULES = ("base", "symbols", "lines")

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Bits of a packed value that hold the position.
_POSITION_BITS = 31


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _without(text: Column, signs: str) -> Column:
    for c in signs:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _agreeing(values: Column, key) -> Column:
    """Of sorted values, those whose key is that of a neighbour."""
    return _let(
        values,
        lambda v: F.filter(
            v,
            lambda x, i: ((i > 0) & (key(x) == key(F.get(v, i - 1)))) | ((i + 1 < F.size(v)) & (key(x) == key(F.get(v, i + 1)))),
        ),
    )


def _pair(h: Column, at: Column) -> Column:
    return F.struct(h.alias("h"), at.alias("at"))


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """The number of words covered by windows of `size` words found twice or more (as long).

    words must be a column of its own, not an expression.
    """
    n_windows = F.size(words) - (size - 1)
    starts = F.sequence(F.lit(0), n_windows - 1)
    hash_at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    mask = (1 << _POSITION_BITS) - 1
    packed = F.transform(starts, lambda i: hash_at(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    near = _agreeing(F.sort_array(packed), lambda x: F.shiftright(x, _POSITION_BITS))
    position = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    pairs = F.transform(near, lambda x: _pair(hash_at(position(x)), position(x)))
    found = F.sort_array(F.transform(_agreeing(F.array_sort(pairs), lambda x: x["h"]), lambda x: x["at"]))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, p: F.struct((s["n"] + (p + size) - F.greatest(s["upto"], p)).alias("n"), (p + size).alias("upto")),
    )["n"]
    return F.when(n_windows < 2, F.lit(0).cast("long")).otherwise(covered)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line (as long)."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    length = F.length(t)
    out = docs.withColumns(
        {
            "_words": words_of(F.col(text)),
            "word_chars": F.length(_without(t, _SPACES)).cast("long"),
            "n_symbols": (length - F.length(_without(t, _SYMBOLS))).cast("long"),
            "n_dup_lines": duplicate_lines(F.col(text)),
        }
    )
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "n_repeat_words": repeat_words(F.col("_words"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words")


def failures() -> dict[str, Column]:
    """Whether a measured document fails each rule."""
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": WORDS_A_REPEATED_LINE * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_rates(measured: DataFrame, host: str = "host", part: float = PART, sure: float = SURE) -> DataFrame:
    """A row for each host: docs, for each rule the failures and the rate shrunk by the rule's beta prior, and rejected.

    With rates r_h of hosts of n_h documents: mean m and variance v over hosts,
    less the mean sampling variance m(1 - m)/n_h, give the prior's weight
    m(1 - m)/v - 1, at least 1 (and 1000 where the hosts do not differ).
    """
    hosts = measured.groupBy(host).agg(F.count("*").alias("docs"), *[F.sum(c.cast("long")).alias(f"failed_{r}") for r, c in failures().items()])
    rate = lambda r: F.col(f"failed_{r}") / F.col("docs")
    inverse = F.avg(1 / F.col("docs")).alias("inverse")
    prior = hosts.agg(inverse, *[f(rate(r)).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))])
    for r in RULES:
        m = F.col(f"m_{r}")
        spread = m * (1 - m)
        between = F.col(f"v_{r}") - spread * F.col("inverse")
        weight = F.when(between > 1e-6, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), spread / F.greatest(between, F.lit(1e-6)) - 1))).otherwise(1000.0)
        prior = prior.withColumn(f"w_{r}", weight)
        prior = prior.withColumn(f"limit_{r}", m + part * (1 - m))
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    over = []
    for r in RULES:
        n = F.col("docs") + F.col(f"w_{r}")
        out = out.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + F.col(f"w_{r}") * F.col(f"m_{r}")) / n)
        p = F.col(f"rate_{r}")
        over.append(p - sure * F.sqrt(p * (1 - p) / (n + 1)) > F.col(f"limit_{r}"))
    return out.select(host, "docs", *[f"{k}_{r}" for r in RULES for k in ("failed", "rate")], reduce(lambda a, b: a | b, over).alias("rejected"))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", part: float = PART, sure: float = SURE) -> DataFrame:
    """A row for each document: doc_id, the measures, base_failed, host_rejected and kept."""
    named, names = plainly(docs)
    rows = named.select(*[F.col(place(names, c)).alias(a) for c, a in ((doc_id, "doc_id"), (host, "host"), (text, "text"))])
    measured = stash(measure(rows).drop("text"), "quality")
    hosts = host_rates(measured, part=part, sure=sure).select(F.col("host").alias("of_host"), F.col("rejected").alias("host_rejected"))
    joined = measured.join(hosts, measured["host"].eqNullSafe(hosts["of_host"]), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
