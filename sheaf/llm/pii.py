"""Personal data: base patterns, then information-theoretic sanitisation, with DataFrame functions only.

Base patterns find emails, IPv4 addresses, card numbers and phone numbers. The
values found are the protected entities. A term discloses an entity as far as it
is informative about it: with frequencies of distinct texts over the corpus, the
pointwise mutual information of term and entity, wherever the two stand in a
text, as a share of the entity's information content. The probability of the
entity, given the term, is taken at its lower (Wilson) bound, so support counts
in the estimate: a term in one text, with the entity, gives the entity a
probability of 0.27, which discloses an entity of one text among 700 or more. Every occurrence of a term
whose share reaches a threshold for some entity is added as a span of kind
"term", in all documents; sanitising replaces spans by the general name of their
kind, or removes them. Terms are looked for outside of base spans.

One pass finds the base spans and distinct terms; its rows, without the texts,
are written to the checkpoint folder. Terms, and pairs of entity and term, are
counted after partial sums. Pairs are rejected by a bound that needs no count of
their entity before they meet that count. Places of terms are looked up only in
the texts that hold one that discloses.

Positions come from splitting the text at marks set around matches; U+E000 is
the mark and is read as U+E001 where a text holds it, which no pattern matches.

Defined results: null text has no spans; repeated rows are handled each by
itself, but equal texts count once, so copies of a document disclose nothing by
their number; an empty table gives an empty table; texts may be of any length;
other columns, whatever their names, are carried along by sanitise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import place, plainly
from sheaf.llm.scratch import discard, stash

#: Kinds in the order of equal starts.
KINDS = ("email", "ip", "card", "phone", "term")
#: The share of an entity's information that a term may give; how sure the estimate's lower bound is, in standard deviations.
DISCLOSURE, SURE = 0.8, 1.645

_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where a run of its first class does, or where the last match ended: the same matches as without that condition, in linear time.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"\p{L}[\p{L}'-]{2,}"
_MARK, _UNMARK = "\ue000", "\ue001"
_BLOCK = 256
#: Tables are sent to the texts by broadcast if their counted size is at most this, and by a shuffle join otherwise.
BROADCAST_BYTES = 16_000_000


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row."""
    return F.transform(F.array(value), then)[0]


def scan(values: Column, zero: Column, step, kind: str) -> Column:
    """All states of a fold over an array, in blocks, so that long arrays cost far less than a square."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    held = lambda last, out: F.struct(last.alias("last"), out.alias("out"))

    def inner(state, block):
        return F.aggregate(block, held(state["last"], none), lambda s, x: _let(step(s["last"], x), lambda n: held(n, F.concat(s["out"], F.array(n)))))

    def whole(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))
        folded = F.aggregate(blocks, held(zero.cast(kind), nones), lambda s, b: _let(inner(s, b), lambda t: held(t["last"], F.concat(s["out"], F.array(t["out"])))))
        return F.when(F.size(v) == 0, none).otherwise(F.flatten(folded["out"]))

    return _let(values, whole)


_FOUND = "struct<start:int,end:int,value:string>"


def occurrences(text: Column, pattern: str, keep=None) -> Column:
    """Matches (those for which keep holds) as array<struct<start, end, value>>, places in code points."""
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_UNMARK)), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    if keep is not None:  # marks of other matches go before places are summed up, which costs most
        kept = lambda x, i: F.when((i % 2 == 1) & keep(x), F.concat(F.lit(_MARK), x, F.lit(_MARK))).otherwise(x)
        marked = F.array_join(F.transform(F.split(marked, _MARK), kept), "")
    step = lambda s, x: F.struct(s["end"].alias("start"), (s["end"] + F.length(x)).alias("end"), x.alias("value"))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))

    def matches(m):
        places = scan(F.split(m, _MARK), zero, step, _FOUND)
        return F.when(F.instr(m, _MARK) > 0, F.filter(places, lambda x, i: i % 2 == 1)).otherwise(F.array().cast(f"array<{_FOUND}>"))

    return _let(marked, matches)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_address(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))


def _is_card(value: Column) -> Column:
    def luhn(d):
        doubled = F.transform(F.split(F.reverse(d), ""), lambda x, i: x.cast("int") * (1 + i % 2))
        return F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0

    return _let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


_CHECKS = {"email": lambda v: F.lit(True), "ip": _is_address, "card": _is_card, "phone": _is_phone}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def base_spans(text: Column) -> Column:
    """Spans of all base kinds as a sorted array<struct<start, kind, end, value>>, kind a place in KINDS.

    text must be a column of its own.
    """
    none = F.array().cast(f"array<{_SPAN}>")

    def of(k: int, kind: str) -> Column:
        found = F.filter(occurrences(text, PATTERNS[kind]), lambda x: _CHECKS[kind](x["value"]))
        spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
        likely = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else text.rlike("[0-9]")
        return F.when(likely, spans).otherwise(none)

    parts = [of(k, kind) for k, kind in enumerate(KINDS[:4])]
    return F.array_sort(F.concat(*parts))


def _entity(span: Column) -> Column:
    own = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), own)


_CUT = "struct<start:int,kind:int,end:int,upto:int>"


def _cuts(spans: Column) -> Column:
    """Spans, each with the end of those before it, without those that are inside of earlier ones."""
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.greatest(s["upto"], s["end"]).alias("upto"))
    return F.filter(scan(spans, zero, step, _CUT), lambda c: c["end"] > c["upto"])


def _outside(text: Column, base: Column) -> Column:
    """text with blanks for its base spans, so that places stay."""

    def blanked(cuts):
        piece = lambda c: F.concat(F.substring(text, c["upto"] + 1, F.greatest(F.lit(0), c["start"] - c["upto"])), F.repeat(F.lit(" "), c["end"] - F.greatest(c["start"], c["upto"])))
        return F.concat(F.array_join(F.transform(cuts, piece), ""), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(base) == 0, text).otherwise(_let(_cuts(base), blanked))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row (numbered, without the text) for each document: base spans, and its distinct entities and terms. Written out."""
    named, names = plainly(docs)
    docs, doc_id, text = named, place(names, doc_id), place(names, text)
    terms = F.array_distinct(F.transform(F.regexp_extract_all("outside", F.lit(_TERM), F.lit(0)), F.lower))
    entities = F.array_distinct(F.transform("base", _entity))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), _text_hash(F.col(text)).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("outside", _outside(F.col("text"), F.col("base")))
    return stash(rows.select("row", "doc_id", "of", "base", entities.alias("entities"), terms.alias("terms")), "pii")


def _once(base: DataFrame) -> DataFrame:
    """One row for each distinct text."""
    copied = stash(base.groupBy("of").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").select("of", "first"), "pii-copied")
    side = F.broadcast(copied) if copied.count() * 24 <= BROADCAST_BYTES else copied
    return base.select("row", "of", "entities", "terms").join(side, "of", "left").where(F.col("first").isNull() | (F.col("first") == F.col("row")))


def lower_bound(both: Column, n: Column) -> Column:
    """The Wilson lower bound of a share of which both of n were seen."""
    z2 = SURE * SURE
    return (both + z2 / 2 - SURE * F.sqrt(both * (n - both) / n + z2 / 4)) / (n + z2)


def disclosing(base: DataFrame, share: float = DISCLOSURE) -> DataFrame:
    """Pairs (entity, term) whose term discloses the entity. Written out."""
    once = _once(base)
    total = F.lit(float(base.select("of").distinct().count()))
    held = once.where(F.size("entities") > 0).select(F.explode("entities").alias("entity"), "terms")
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    terms = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))

    def discloses(n_entity: Column) -> Column:
        own = F.log(total / n_entity)
        given = own + F.log(lower_bound(F.col("both"), F.col("n_term")))
        return (own > 0) & (given >= share * own)

    # The share is largest for an entity that is in no other texts than those with the term: most pairs end here.
    pairs = pairs.join(terms, "term").where(discloses(F.col("both")))
    return stash(pairs.join(entities, "entity").where(discloses(F.col("n_entity"))).select("entity", "term"), "pii-pairs")


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("_hash", F.xxhash64(*keys))


def _meet(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to a written table on equal keys, nulls too; a broadcast of the table's hashes, if they are few, thins rows first."""
    if table.count() * 16 <= BROADCAST_BYTES:
        hashes = _hashed(table.select(*keys), keys).select("_hash").distinct()
        rows = _hashed(rows, keys).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return _null_safe(rows, table, keys, "inner")


def _null_safe(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    side = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(side, same, how).drop(*[f"_{k}" for k in keys])


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: float = DISCLOSURE) -> DataFrame:
    """A row for each document: row, doc_id, of (a hash of the text), base and spans (base and terms), sorted arrays of spans."""
    base = found(docs, text, doc_id)
    terms = stash(disclosing(base, share).select("term").distinct(), "pii-terms")
    own = base.select("row", "doc_id", "of", "base")
    if terms.isEmpty():
        return own.withColumn("spans", F.col("base"))
    hits = _meet(base.select("doc_id", "of", F.explode("terms").alias("term")), terms, ["term"])
    hits = stash(hits.groupBy("doc_id", "of").agg(F.collect_set("term").alias("hit")), "pii-hits")
    named, names = plainly(docs)
    texts = named.select(F.col(place(names, doc_id)).alias("doc_id"), F.col(place(names, text)).alias("text")).withColumn("of", _text_hash(F.col("text")))
    texts = _meet(texts, hits, ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])
    texts = texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("base", base_spans(F.col("text")))
    places = occurrences(_outside(F.col("text"), F.col("base")), _TERM, lambda x: F.array_contains("hit", F.lower(x)))
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"), F.lower(x["value"]).alias("value"))
    added = stash(texts.select("doc_id", "of", F.transform(places, span).alias("added")), "pii-added")
    none = F.array().cast(f"array<{_SPAN}>")
    joined = _null_safe(own, added, ["doc_id", "of"], "left")
    return joined.select("row", "doc_id", "of", "base", F.array_sort(F.concat("base", F.coalesce(F.col("added"), none))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    own = spans(docs, text, doc_id)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return own.select("doc_id", *[count(k) for k in range(4)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count(4))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", names: dict[str, str] | None = None) -> DataFrame:
    """docs, with the same columns, with each span of its text generalised to its kind (names: other texts for kinds, "" removes).

    Overlapping spans are cut at the end of the one that starts first.
    """
    general = {k: f"<{k.upper()}>" for k in KINDS} | (names or {})
    named, own_names = plainly(docs)
    i, t = place(own_names, doc_id), place(own_names, text)
    own = spans(named, t, i)
    own = own.where(F.size("spans") > 0).dropDuplicates(["doc_id", "of"])
    cuts = stash(own.select("doc_id", "of", _cuts(F.col("spans")).alias("cuts")), "pii-cuts")
    size = cuts.agg(F.sum(F.size("cuts") * 24 + 64 + F.length(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).first()[0] or 0
    side = F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts
    labels = F.array(*[F.lit(general[k]) for k in KINDS])
    joined = named.join(side, named[i].eqNullSafe(cuts["doc_id"]) & (_text_hash(named[t]) == cuts["of"]), "left")
    whole = F.col(t)
    piece = lambda c: F.concat(F.substring(whole, c["upto"] + 1, F.greatest(F.lit(0), c["start"] - c["upto"])), F.get(labels, c["kind"]))
    rest = F.substring(whole, F.element_at("cuts", -1)["end"] + 1, F.length(whole))
    new = F.when(F.col("cuts").isNull(), whole).otherwise(F.concat(F.array_join(F.transform("cuts", piece), ""), rest))
    return joined.withColumn(t, new).select(*named.columns).toDF(*own_names)
