"""Queries over the sample tables, one for each operation, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, counts, decontaminate, language, minhash, pii, quality, substrings, toxicity, urls
from sheaf.runtime import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of one of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, tokenizer_file(), decoded="decoded")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.in_fold("doc_id", 4, 2)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.measured(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.in_fold("doc_id", 5, 0)
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.token_counts(docs, tokenizer_file("byte_bpe_50k.tiktoken")).select("doc_id", "n_pretokens", "n_tokens")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, similarity=0.8)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_quality_rules": rf"""
with w as (select doc_id, source, coalesce(text, '') as t, {_SPLIT} as w from documents),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from w, unnest(range(1, len(w) - 1)) as x(i)),
many as (select doc_id, g from win group by all having count(*) > 1),
covered as (select doc_id, count(distinct i + o) as n from (select win.doc_id, i from win join many on win.doc_id = many.doc_id and win.g = many.g), range(3) as r(o) group by doc_id),
lines as (select doc_id, sum(n - 1) as n from (select doc_id, x, count(*) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by all) group by doc_id),
m as (select w.doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from w left join lines on w.doc_id = lines.doc_id left join covered on w.doc_id = covered.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
r as (select doc_id, source, rule, failed from (select *, base_failed as base, 100 * n_symbols > 10 * word_chars as symbols, 20 * n_dup_lines > n_words as lines from b) unpivot (failed for rule in (base, symbols, lines))),
h as (select source, rule, count(*) as docs, sum(failed::int) as failed from r group by all),
p as (select rule, avg(failed / docs) as m, var_pop(failed / docs) - avg(failed / docs) * (1 - avg(failed / docs)) * avg(1 / docs) as v from h group by rule),
k as (select *, case when v > 1e-6 then greatest(1, least(1000, m * (1 - m) / greatest(v, 1e-6) - 1)) else 1000 end as weight from p),
l as (select source, docs + weight as n, (failed + weight * m) / (docs + weight) as rate, m + 0.5 * (1 - m) as most from h join k on h.rule = k.rule),
x as (select source, bool_or(rate - 3 * sqrt(rate * (1 - rate) / (n + 1)) > most) as rejected from l group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
from b join x on b.source is not distinct from x.source""",
    "op8_substring_dedup": rf"""
with w as (select doc_id, {_SPLIT} as w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') as g from w, unnest(range(1, len(w) - 33)) as x(i)),
many as (select g from win group by g having count(*) > 1),
covered as (select distinct doc_id, i + o as k from (select doc_id, i from win join many on win.g = many.g), range(35) as r(o)),
words as (select doc_id, k, w[k] as word from w, unnest(range(1, len(w) + 1)) as x(k)),
kept as (select words.doc_id, string_agg(word, ' ' order by words.k) as t, count(*) as n from words left join covered on words.doc_id = covered.doc_id and words.k = covered.k where covered.k is null group by words.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id""",
    "op10_benchmark_decontamination": rf"""
with w as (select doc_id, {_FOLDED} as w from documents),
b as (select item_id, {_FOLDED} as w from benchmark),
items as (select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as g from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) as x(i) where len(w) > 0),
sizes as (select distinct n from items),
win as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g from (select * from w, sizes), unnest(range(1, len(w) - n + 2)) as x(i)),
hits as (select doc_id, i, win.n, cast(item_id as varchar) as item from win join items on win.n = items.n and win.g = items.g),
covered as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
found as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(covered.n, 0) as bigint) as n_hit, cast(coalesce(found.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
coalesce(covered.n, 0) > 0 and 20 * coalesce(covered.n, 0) >= len(w) as contaminated from w left join covered on w.doc_id = covered.doc_id left join found on w.doc_id = found.doc_id""",
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that are neither learned nor encoded (near-duplicates would need all pairs)."""
    return dict(ORACLES)
