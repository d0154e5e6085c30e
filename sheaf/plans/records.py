"""Queries: projection, filters, rules, record numbers and record state."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import coerce
from sheaf.operators import ordered
from sheaf.plans.registry import query, table
from sheaf.script import Script

_NUM = r"coalesce(try_cast(regexp_extract({}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0) as double), 0)"


@query("select l_orderkey, l_quantity, l_shipdate::varchar as shipped from lineitem")
def select_fields(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


@query("select * exclude (l_shipdate) from lineitem where l_quantity > 45 and l_discount < 0.02")
def filter_numeric(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.02)).drop("l_shipdate")


@query("select c_custkey, c_name from customer where regexp_matches(c_name, '0+[1-5]7$')")
def filter_regex(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").rlike("0+[1-5]7$")).select("c_custkey", "c_name")


@query("select p_partkey, p_type from part where not regexp_matches(p_type, '[AEIOU]{2}|N$')")
def filter_not_regex(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~F.col("p_type").rlike("[AEIOU]{2}|N$")).select("p_partkey", "p_type")


@query("select c_custkey, c_name from customer where starts_with(c_name, 'Customer') and ends_with(c_name, '5') and contains(c_name, '00')")
def filter_literal_patterns(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").where(name.startswith("Customer") & name.endswith("5") & name.contains("00")).select("c_custkey", "c_name")


@query("select n_nationkey, n_name from nation where n_name >= 'J' and n_name < 'S'")
def filter_string_cmp(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").where(coerce.compare(">=", n, "str", F.lit("J"), "str") & coerce.compare("<", n, "str", F.lit("S"), "str")).select("n_nationkey", "n_name")


@query(f"select event_id from events where {_NUM.format('substr(props, 7)')} >= 50")
def filter_mixed_cmp(spark, sf_dir):
    number = F.col("props").substr(F.lit(7), F.length("props"))
    return table(spark, sf_dir, "events").where(coerce.compare(">=", number, "str", F.lit(50), "int")).select("event_id")


@query("select o_orderkey, cast(o_totalprice > 100000 and o_orderstatus = 'F' or o_custkey % 7 = 0 as bigint) as both, cast(not (o_custkey % 2 <> 0) as bigint) as even from orders")
def logic_short_circuit(spark, sf_dir):
    even = ~coerce.truthy(F.col("o_custkey") % 2, "int")
    both = ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")) | (F.col("o_custkey") % 7 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", both.cast("bigint").alias("both"), even.cast("bigint").alias("even"))


@query("select p_partkey, case when p_size > 25 then 'large' else cast(p_size as varchar) end as label from part")
def ternary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise(F.col("p_size").cast("string")).alias("label"))


@query("""select event_id, 1 as rule, 'big' as says from events where value > 100 union all select event_id, 2, event_type from events where event_type like '%r%'
union all select event_id, 3, 'user' from events where user_id % 10 = 0""")
def rule_union_order(spark, sf_dir):
    rules = F.array(
        F.when(F.col("value") > 100, F.struct(F.lit(1).alias("rule"), F.lit("big").alias("says"))),
        F.when(F.col("event_type").contains("r"), F.struct(F.lit(2).alias("rule"), F.col("event_type").alias("says"))),
        F.when(F.col("user_id") % 10 == 0, F.struct(F.lit(3).alias("rule"), F.lit("user").alias("says"))),
    )
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("event_id", "r.rule", "r.says")


@query("""select event_id, case when value > 100 then 'big' when event_type = 'error' then 'error' else 'rest' end as says from events""")
def next_guard(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.concat_ws("\t", "event_id", "event_type", F.col("value").cast("double")).alias("line"))
    said = Script('$3 > 100.0 { print $1 "\\tbig"; next } $2 == "error" { print $1 "\\terror"; next } { print $1 "\\trest" }', {"FS": "\t"}).run(lines)
    f = F.split("line", "\t")
    return said.select(f[0].cast("bigint").alias("event_id"), f[1].alias("says"))


@query("select event_id, row_number() over (order by event_id) as nr from events")
def record_number(spark, sf_dir):
    return ordered.record_number(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id) as nr from events")
def file_record_number(spark, sf_dir):
    return ordered.record_number(table(spark, sf_dir, "events").select("user_id", "event_id"), ["event_id"], ["user_id"])


@query("select event_id from (select event_id, row_number() over (order by event_id) as nr from events) where nr % 3 = 1")
def every_nth(spark, sf_dir):
    return ordered.every_nth(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 3, 1)


_RANGE = """with s as (select *, last_value(case when event_type = 'error' then 0 when event_type = 'signup' then 1 end ignore nulls) over ({} order by event_id rows between unbounded preceding and 1 preceding) as st from events)
select event_id, user_id, event_type from s where event_type = 'signup' or st = 1{}"""


@query(_RANGE.format("partition by user_id", " or event_type = 'error'"))
def range_pattern(spark, sf_dir):
    kind = F.col("event_type")
    return ordered.range_pattern(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"], kind == "signup", kind == "error", ["user_id"])


@query(_RANGE.format("", ""))
def range_pattern_classic(spark, sf_dir):
    kind = F.col("event_type")
    return ordered.range_pattern(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"], kind == "signup", kind == "error", classic=True)


@query("select event_id, event_type, coalesce(lag(event_type) over (order by event_id), '') as previous from events qualify event_type <> previous")
def prev_record_change(spark, sf_dir):
    out = ordered.previous_record(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], F.col("event_type"), default="")
    return out.where("event_type <> previous")


@query("select event_id, coalesce(lead(event_id) over (order by event_id), -1) as following from events")
def next_record_pair(spark, sf_dir):
    return ordered.next_record(table(spark, sf_dir, "events").select("event_id"), ["event_id"], F.col("event_id"), default=-1)


@query("select o_orderkey, round(sum(o_totalprice) over (order by o_orderkey rows unbounded preceding), 2) as total from orders")
def running_total(spark, sf_dir):
    out = ordered.running_total(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], F.col("o_totalprice").cast("decimal(20,4)"))
    return out.select("o_orderkey", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as nr from events) where nr > 2")
def skip_header_rows(spark, sf_dir):
    return ordered.skip_first(table(spark, sf_dir, "events").select("user_id", "event_id"), ["event_id"], 2, ["user_id"])


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 25")
def first_n(spark, sf_dir):
    return ordered.first_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 25)


@query("""with f as (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as fired from events)
select user_id, event_id, event_type from f where coalesce(fired, 0) = 0""")
def nextfile_prefix(spark, sf_dir):
    return ordered.until(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["event_id"], F.col("event_type") == "purchase", ["user_id"])


@query("select cast(least(100, count(*)) as bigint) as n, cast(least(100, count(*)) as bigint) as n_different, true as all_known from events")
def rand_sample_size(spark, sf_dir):
    """Which rows are drawn is left to chance; how many, that they differ and that they are rows is not."""
    events = table(spark, sf_dir, "events").select("event_id")
    drawn = rand_sample(spark, sf_dir)
    known = drawn.join(events.distinct().withColumn("known", F.lit(True)), "event_id", "left")
    return known.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_different"), F.every(F.coalesce("known", F.lit(False))).alias("all_known"))


@query()
def rand_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id").orderBy(F.rand(7)).limit(100)
