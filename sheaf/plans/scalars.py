"""Queries: conversions, fields, text, mathematics and bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import coerce, fields, mathx, text
from sheaf.plans.registry import query, table
from sheaf.sources import readers, sinks

_NUM = r"coalesce(try_cast(regexp_extract({}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0) as double), 0)"
_INT = r"coalesce(try_cast(regexp_extract({}, '^[+-]?[0-9]+', 0) as bigint), 0)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"select p_partkey, {_NUM.format('cast(p_retailprice as varchar)')} as whole, {_NUM.format('p_name')} as name_number, {_NUM.format('substr(p_brand, 7)')} as brand_number from part")
def num_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", coerce.to_num(F.col("p_retailprice").cast("string")).alias("whole"), coerce.to_num(F.col("p_name")).alias("name_number"), coerce.to_num(F.col("p_brand").substr(F.lit(7), F.length("p_brand"))).alias("brand_number"))


@query(f"select c_custkey, cast(trunc(c_acctbal) as bigint) as whole, {_INT.format('substr(c_name, 10)')} as number from customer")
def int_trunc(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", coerce.float_to_int(F.col("c_acctbal")).alias("whole"), coerce.to_int(F.col("c_name").substr(F.lit(10), F.length("c_name"))).alias("number"))


@query("select p_partkey, cast(p_size as varchar) as i, cast(cast(p_size * 2 as bigint) as varchar) as whole, regexp_replace(cast(p_size / 8.0 as varchar), '\\.0$', '') as eighths from part")
def num_to_text(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", coerce.as_kind(size, "int", "str").alias("i"), coerce.num_to_text((size * 2).cast("double")).alias("whole"), coerce.num_to_text(size / 8.0).alias("eighths"))


@query("select event_id, cast(trunc(value) <> 0 as bigint) as f, cast(user_id <> 0 as bigint) as i, cast(event_type <> '' as bigint) as s from events")
def truthiness(spark, sf_dir):
    t = lambda c, k: coerce.truthy(F.col(c), k).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", t("value", "float").alias("f"), t("user_id", "int").alias("i"), t("event_type", "str").alias("s"))


@query("select o_orderkey, o_orderkey as back, -o_orderkey as minus from orders")
def hex_to_int(spark, sf_dir):
    h = F.lower(F.hex("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.hex_to_int(F.concat(F.lit("0x"), h)).alias("back"), text.hex_to_int(F.concat(F.lit("-0x"), h, F.lit("zz"))).alias("minus"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda x: x <> '')) as nf from documents")
def field_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fields.count(text.split_fields(F.col("text"))).alias("nf"))


@query("""select doc_id, coalesce(f[1], '') as first, coalesce(f[3], '') as third, coalesce(f[len(f)], '') as last from
(select doc_id, list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda x: x <> '') as f from documents)""")
def field_nth(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", text.split_fields(F.col("text")).alias("f"))
    last = F.when(F.size("f") == 0, "").otherwise(fields.nth(F.col("f"), F.greatest(F.lit(1), F.size("f"))))
    return df.select("doc_id", fields.nth(F.col("f"), 1).alias("first"), fields.nth(F.col("f"), 3).alias("third"), last.alias("last"))


@query("select c_custkey, c_name || '|' || 'new' || '|' || '' || '|' || 'x' as line from customer")
def field_assign_rebuild(spark, sf_dir):
    f = F.split("c_name", "@")
    return table(spark, sf_dir, "customer").select("c_custkey", fields.rebuild(fields.assign(fields.assign(f, 2, F.lit("new")), 4, F.lit("x")), "|").alias("line"))


@query("select n_nationkey, array_to_string(list_slice([n_name, n_nationkey::varchar, n_regionkey::varchar], 2, 9), '-') as joined from nation")
def join_fields(spark, sf_dir):
    f = F.array("n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", fields.join_fields(f, 2, 9, "-").alias("joined"))


_CSV = """case when regexp_matches({0}, '[",\\t\\n]') then '"' || replace(replace(replace({0}, '"', '""'), chr(9), '\\t'), chr(10), '\\n') || '"' else {0} end"""
_TSV = "replace(replace({0}, chr(9), '\\t'), chr(10), '\\n')"


@query(f"select event_id, event_type || ',' || {_CSV.format('props')} as line from events")
def join_csv(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fields.join_csv(F.array("event_type", "props"), 1, 2).alias("line"))


@query(f"select doc_id, {_TSV.format('text')} || chr(9) || lang as line from documents")
def join_tsv(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.join_tsv(F.array("text", "lang"), 1, 2).alias("line"))


@query(f"select doc_id, {_CSV.format('text')} as line from documents")
def escape_csv(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.escape_csv(F.col("text")).alias("line"))


@query(f"select doc_id, {_TSV.format('text')} as line from documents")
def escape_tsv(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.escape_tsv(F.col("text")).alias("line"))


_BACK = r"replace(replace(replace(replace(replace(replace({0}, chr(9), '\t'), chr(10), '\n'), '\\', chr(57344)), '\t', chr(9)), '\n', chr(10)), chr(57344), '\')"


@query(f"select doc_id, case when regexp_matches(coalesce(text, ''), '[\",\t\n]') then {_BACK.format('text')} else coalesce(text, '') end as second, 'a\"b' as third, cast(3 as bigint) as nf from documents")
def csv_parse(spark, sf_dir):
    df = _docs(spark, sf_dir)
    f = df.select("doc_id", readers.csv_fields(sinks.csv_line(F.col("doc_id"), F.col("text"), F.lit('a"b'))).alias("f"))
    return f.select("doc_id", F.get("f", 1).alias("second"), F.get("f", 2).alias("third"), fields.count(F.col("f")).alias("nf"))


@query(f"select doc_id, {_BACK.format("coalesce(text, '')")} as second, cast(2 as bigint) as nf from documents")
def tsv_parse(spark, sf_dir):
    df = _docs(spark, sf_dir)
    f = df.select("doc_id", readers.tsv_fields(sinks.tsv_line(F.col("doc_id"), F.col("text"))).alias("f"))
    return f.select("doc_id", F.get("f", 1).alias("second"), fields.count(F.col("f")).alias("nf"))


@query("select doc_id, strlen(text) as bytes, length(text) as chars from documents")
def length_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.length(F.col("text")).alias("bytes"), text.length(F.col("text"), "char").alias("chars"))


@query("select n_nationkey, substr(n_name, 2, 3) as mid, substr(n_name, 1, 4) as clamped, substr(n_name, 3) as tail, '' as none from nation")
def substr_clamped(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.substr(n, 2, 3).alias("mid"), text.substr(n, -20, 4).alias("clamped"), text.substr(n, 3).alias("tail"), text.substr(n, 2, -1).alias("none"))


@query("select doc_id, case when instr(text, 'the') > 0 then strlen(substr(text, 1, cast(instr(text, 'the') as int) - 1)) + 1 else 0 end as at, instr(text, 'the') as at_char from documents")
def index_of(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.index(t, F.lit("the")).alias("at"), text.index(t, F.lit("the"), "char").alias("at_char"))


@query("""select doc_id, case when m = '' then 0 else instr(text, m) end as rstart, case when m = '' then -1 else length(m) end as rlength from
(select doc_id, text, regexp_extract(text, '[0-9]+', 0) as m from documents)""")
def match_loc(spark, sf_dir):
    at, size = text.match_place(F.col("text"), "[0-9]+")
    return _docs(spark, sf_dir).select("doc_id", at.alias("rstart"), size.alias("rlength"))


@query("select doc_id, p as pos, w as word from (select doc_id, unnest(f) as w, generate_subscripts(f, 1) as p from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda x: x <> '') as f from documents))")
def split_blank(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return df.select("doc_id", F.posexplode(text.split_fields(F.col("text"))).alias("pos", "word")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "word")


@query("select c_custkey, regexp_split_to_array(c_name, '#0*')[1] as a, regexp_split_to_array(c_name, '#0*')[2] as b from customer")
def split_regex(spark, sf_dir):
    f = text.split_fields(F.col("c_name"), "#0*")
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(f, 0).alias("a"), F.get(f, 1).alias("b"))


@query("select doc_id, regexp_replace(text, '[aeiou]+', '<\\0>') as new from documents")
def sub_first(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.sub(F.col("text"), "[aeiou]+", "<&>").alias("new"))


@query("select doc_id, regexp_replace(text, '[0-9]+', '[\\0]', 'g') as new, len(regexp_extract_all(text, '[0-9]+')) as n from documents")
def gsub_all_count(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.gsub(t, "[0-9]+", "[&]").alias("new"), text.gsub_count(t, "[0-9]+").alias("n"))


@query("select n_nationkey, regexp_replace(n_name, '^([^AEIOU]*[AEIOU]+[^AEIOU]*)([AEIOU]+)', '\\1-') as new from nation")
def gensub_nth(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.gensub(F.col("n_name"), "[AEIOU]+", "-", 2).alias("new"))


@query("select c_custkey, regexp_replace(c_name, '([A-Z])[a-z]*([a-z])#([0-9]+)', '\\3-\\2\\1', 'g') as new from customer")
def gensub_backrefs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.gensub(F.col("c_name"), "([A-Z])[a-z]*([a-z])#([0-9]+)", r"\3-\2\1", "g").alias("new"))


@query("select p_partkey, printf('%5d|%-6d|%05d|%s|%.2f|%x|%o|%%', p_size, p_size, p_size, p_brand, p_retailprice, p_size, p_size) as line from part")
def sprintf_pad(spark, sf_dir):
    s, b, r = (F.col("p_size"), "int"), (F.col("p_brand"), "str"), (F.col("p_retailprice"), "float")
    return table(spark, sf_dir, "part").select("p_partkey", text.sprintf("%5d|%-6d|%05d|%s|%.2f|%x|%o|%%", s, s, s, b, r, s, s).alias("line"))


@query("select doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as new from documents")
def ascii_upper(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.upper_ascii(F.col("text")).alias("new"))


@query("select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as new from documents")
def ascii_lower(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.lower_ascii(F.col("text")).alias("new"))


@query("select n_nationkey, n_name || n_nationkey::varchar || '/' || (n_regionkey + 1)::varchar as line from nation")
def concat_text(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.col("n_nationkey").cast("string"), F.lit("/"), (F.col("n_regionkey") + 1).cast("string")).alias("line"))


@query("select l_orderkey, l_linenumber, l_partkey + l_suppkey as a, l_partkey - l_suppkey as b, l_partkey * l_suppkey as c, coalesce(l_partkey % nullif(l_suppkey, 0), 0) as d, l_quantity * 2 + 1 as e from lineitem")
def arith_types(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mathx.add_int(p, s).alias("a"), mathx.subtract_int(p, s).alias("b"), mathx.multiply_int(p, s).alias("c"), mathx.modulo_int(p, s).alias("d"), (F.col("l_quantity") * 2 + 1).alias("e"))


@query("select p_partkey, round(p_retailprice / p_size, 6) as quotient, round(pow(p_size, 1.5), 6) as power, case when p_size = 25 then 1 else 0 end as infinite from part")
def div_pow(spark, sf_dir):
    q = mathx.divide(F.lit(1.0), (F.col("p_size") - 25).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(mathx.divide(F.col("p_retailprice"), F.col("p_size")), 6).alias("quotient"), F.round(F.pow("p_size", F.lit(1.5)), 6).alias("power"), (q == float("inf")).cast("int").alias("infinite"))


@query("select event_id, round(value % 7.5, 6) as r, round(-value % 7.5, 6) as s from events")
def float_mod(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(mathx.modulo_float(v, F.lit(7.5)), 6).alias("r"), F.round(mathx.modulo_float(-v, F.lit(7.5)), 6).alias("s"))


@query("select p_partkey, round(sin(p_size), 8) as s, round(cos(p_size), 8) as c, round(atan(p_size), 8) as a, round(atan2(p_size, 3), 8) as b from part")
def trig(spark, sf_dir):
    p = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.sin(p), 8).alias("s"), F.round(F.cos(p), 8).alias("c"), F.round(F.atan(p), 8).alias("a"), F.round(F.atan2(p, F.lit(3)), 8).alias("b"))


@query("select p_partkey, round(ln(p_size), 8) as e, round(log2(p_size), 8) as two, round(log10(p_size), 8) as ten, round(exp(p_size / 50.0), 8) as up, round(sqrt(p_size), 8) as root, 1 as edges from part")
def logs(spark, sf_dir):
    p = F.col("p_size")
    zero, below = p.cast("double") * 0, -p.cast("double")
    edges = (mathx.log(zero) == float("-inf")) & F.isnan(mathx.log(below, "10"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(mathx.log(p), 8).alias("e"), F.round(mathx.log(p, "2"), 8).alias("two"), F.round(mathx.log(p, "10"), 8).alias("ten"), F.round(F.exp(p / 50.0), 8).alias("up"), F.round(F.sqrt(p), 8).alias("root"), edges.cast("int").alias("edges"))


@query("select o_orderkey, o_orderkey & o_custkey as a, o_orderkey | o_custkey as o, xor(o_orderkey, o_custkey) as x, ~o_orderkey as c from orders")
def bit_ops(spark, sf_dir):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", mathx.bit_and(a, b).alias("a"), mathx.bit_or(a, b).alias("o"), mathx.bit_xor(a, b).alias("x"), mathx.bit_not(a).alias("c"))


@query("select o_orderkey, o_orderkey * 8 as l, cast(floor(-o_orderkey / 4.0) as bigint) as r, o_orderkey >> 1 as u from orders")
def shifts(spark, sf_dir):
    a = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", mathx.shift_left(a, 3).alias("l"), mathx.shift_right(-a, 66).alias("r"), mathx.shift_right_logical(a, 1).alias("u"))


@query("""select user_id, cast(cardinality(m) as bigint) as n, coalesce(m['error'], 0) as errors, cast(m['nothing'] is null as bigint) as absent from
(select user_id, map_from_entries(list((event_type, n))) as m from (select user_id, event_type, count(*) as n from events group by all) group by user_id)""")
def map_lookup(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.size("m").cast("bigint").alias("n"), F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).alias("errors"), (~F.map_contains_key("m", F.lit("nothing"))).cast("bigint").alias("absent"))


@query("select user_id, event_type, n from (select user_id, event_type, count(*) as n from events group by all) where event_type <> 'view'")
def map_delete(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode(F.map_filter("m", lambda k, v: k != "view")).alias("event_type", "n"))
