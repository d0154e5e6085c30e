"""Queries: aggregates, lookups, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import keyed, lookup
from sheaf.operators.ordered import control_break, record_number
from sheaf.plans.registry import query, table


@query("select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as mean_price from lineitem group by l_returnflag, l_linestatus")
def group_mean_by_key(spark, sf_dir):
    out = keyed.keyed_mean(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", value=F.col("l_extendedprice"), name="mean_price")
    return out.withColumn("mean_price", F.round("mean_price", 4))


@query("select round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice), 2) as price from lineitem")
def sum_two_columns(spark, sf_dir):
    out = keyed.global_sum(table(spark, sf_dir, "lineitem"), quantity=F.col("l_quantity"), price=F.col("l_extendedprice"))
    return out.select(F.round("quantity", 2).alias("quantity"), F.round("price", 2).alias("price"))


@query("select round(coalesce(sum(case when l_returnflag = 'R' then 1.5 * l_extendedprice when l_returnflag = 'A' then 0.5 * l_extendedprice end), 0), 2) as total from lineitem where l_quantity > 10")
def scaled_filtered_sum(spark, sf_dir):
    price = F.col("l_extendedprice")
    scaled = F.when(F.col("l_returnflag") == "R", 1.5 * price).when(F.col("l_returnflag") == "A", 0.5 * price)
    return keyed.global_sum(table(spark, sf_dir, "lineitem").where("l_quantity > 10"), total=scaled).select(F.round("total", 2).alias("total"))


@query("""select count(l_quantity) as q_n, min(l_quantity) as q_min, max(l_quantity) as q_max, round(avg(l_quantity), 6) as q_mean, round(stddev_samp(l_quantity), 6) as q_dev,
count(l_tax) as t_n, min(l_tax) as t_min, max(l_tax) as t_max, round(avg(l_tax), 6) as t_mean, round(stddev_samp(l_tax), 6) as t_dev from lineitem""")
def column_statistics(spark, sf_dir):
    out = keyed.column_statistics(table(spark, sf_dir, "lineitem"), q=F.col("l_quantity"), t=F.col("l_tax"))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "dev")) else F.col(c) for c in out.columns])


@query("select event_type, count(*) as n from events group by event_type")
def histogram(spark, sf_dir):
    return keyed.histogram(table(spark, sf_dir, "events"), "event_type")


@query("select user_id, round(sum(value), 4) as total from events group by user_id")
def keyed_sum(spark, sf_dir):
    return keyed.keyed_sum(table(spark, sf_dir, "events"), "user_id", value=F.col("value")).withColumn("total", F.round("total", 4))


@query("select user_id, event_type, round(sum(value), 4) as total from events group by user_id, event_type")
def composite_key_sum(spark, sf_dir):
    return keyed.keyed_sum(table(spark, sf_dir, "events"), "user_id", "event_type", value=F.col("value")).withColumn("total", F.round("total", 4))


@query("select event_type, min(value) as low, max(value) as high, greatest(0, max(value)) as high_from_zero from events group by event_type")
def min_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.greatest(F.lit(0.0), F.max("value")).alias("high_from_zero"))


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as r from events) where r = 1")
def argmax_first(spark, sf_dir):
    return keyed.argmax_first(table(spark, sf_dir, "events"), F.col("value"), F.col("event_id"), F.col("event_id"), F.col("value"), keys=["event_type"])


@query("select n_regionkey, string_agg(n_name, ' ' order by n_nationkey) as joined from nation group by n_regionkey")
def ordered_concat(spark, sf_dir):
    return keyed.ordered_concat(table(spark, sf_dir, "nation"), ["n_regionkey"], F.col("n_name"), F.col("n_nationkey"))


@query("select count(distinct user_id) as n from events")
def count_distinct_keys(spark, sf_dir):
    return keyed.distinct_count(table(spark, sf_dir, "events"), F.col("user_id"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r = 1")
def first_seen(spark, sf_dir):
    return keyed.first_seen(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), F.col("event_id"), F.col("event_type"))


@query("select user_id, arg_max(event_type, event_id) as value from events group by user_id")
def last_write_map(spark, sf_dir):
    return keyed.last_write(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), F.col("event_id"))


@query("""with c as (select *, case when event_type <> lag(event_type) over (partition by user_id order by event_id) then 1 else 0 end as ch from events),
r as (select *, sum(ch) over (partition by user_id order by event_id rows unbounded preceding) as run from c)
select user_id, cast(run as bigint) as run, event_type as key, count(*) as n, round(sum(value), 4) as total from r group by user_id, run, event_type""")
def control_break_totals(spark, sf_dir):
    out = control_break(table(spark, sf_dir, "events"), ["event_id"], F.col("event_type"), F.col("value"), ["user_id"])
    return out.withColumn("total", F.round("total", 4))


@query("select event_type, round(sum(value), 4) as total from events group by rollup(event_type)")
def subtotals_and_grand_total(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query("select o_orderstatus, coalesce(max(nullif(case when o_orderkey % 3 = 0 then o_orderpriority else '' end, '')), '') as value from orders group by o_orderstatus")
def merge_any_nonempty(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("")
    return keyed.any_nonempty(table(spark, sf_dir, "orders"), ["o_orderstatus"], text)


@query("select cast(event_id % 4 + 1 as bigint) as pid, count(*) as n, max(value) as high from events group by event_id % 4")
def partition_partials(spark, sf_dir):
    return keyed.partial_totals(table(spark, sf_dir, "events"), 4, F.col("event_id"), n=F.count("*"), high=F.max("value"))


@query("select count(*) as nr from events")
def total_records(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("nr"))


@query("select p_brand, cast(round(exp(sum(ln(1 + p_size / 1000.0))) * 1000000) as bigint) as product, cast(-sum(p_size) as bigint) as down from part group by p_brand")
def keyed_other_updates(spark, sf_dir):
    product = keyed.keyed_product(table(spark, sf_dir, "part"), "p_brand", value=1 + F.col("p_size") / 1000, p_down=-F.col("p_size"))
    return product.select("p_brand", F.round(F.col("product") * 1000000).cast("bigint").alias("product"), F.col("p_down").cast("bigint").alias("down"))


@query("select event_type, count(*) as n from events group by event_type having count(*) > 10")
def having_filter(spark, sf_dir):
    return keyed.histogram(table(spark, sf_dir, "events"), "event_type").where("n > 10")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def lookup_inner(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    return lookup.inner(table(spark, sf_dir, "orders"), "o_custkey", rich, "c_custkey", "c_name", "c_custkey", "c_name").select("o_orderkey", "c_name")


@query("select o_orderkey, coalesce(c_name, '') as c_name from orders left join (select * from customer where c_acctbal > 5000) on o_custkey = c_custkey")
def lookup_left_default(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    return lookup.left_default(table(spark, sf_dir, "orders"), "o_custkey", rich, "c_custkey", "c_name", "c_custkey", "c_name", "").select("o_orderkey", "c_name")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def lookup_semi(spark, sf_dir):
    return lookup.semi(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey", "o_custkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def lookup_anti(spark, sf_dir):
    return lookup.anti(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "c_name")


@query("select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey")
def multi_match_join(spark, sf_dir):
    return lookup.theta(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_custkey")


@query("select s_suppkey, n_name from supplier, nation where s_nationkey < n_nationkey and contains(s_name, cast(n_nationkey as varchar))")
def nested_loop_pairs(spark, sf_dir):
    holds = F.col("s_name").contains(F.col("n_nationkey").cast("string"))
    return lookup.theta(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), (F.col("s_nationkey") < F.col("n_nationkey")) & holds).select("s_suppkey", "n_name")


@query("""select a.nr, c_name, s_name from (select c_name, row_number() over (order by c_custkey) as nr from customer) a
join (select s_name, row_number() over (order by s_suppkey desc) as nr from supplier) b on a.nr = b.nr""")
def positional_merge(spark, sf_dir):
    out = lookup.positional(table(spark, sf_dir, "customer"), ["c_custkey"], table(spark, sf_dir, "supplier").withColumn("back", -F.col("s_suppkey")), ["back"])
    return out.select("nr", "c_name", "s_name")


@query("select p_partkey, p_retailprice from part order by p_retailprice, p_partkey")
def sort_numeric(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey")


@query("select c_mktsegment, c_acctbal, c_custkey from customer order by c_mktsegment, c_acctbal desc, c_custkey")
def sort_multi_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("select n_name as name from nation union all select r_name from region")
def union_files(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionAll(table(spark, sf_dir, "region").select("r_name"))


@query("select distinct c_nationkey as k from customer union select s_nationkey from supplier")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("select c_custkey as k from customer except select o_custkey from orders")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("select o_orderkey, o_custkey, row_number() over (order by o_orderkey desc) as nr from orders")
def reverse_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("back", -F.col("o_orderkey"))
    return record_number(orders, ["back"], name="nr").drop("back")


@query("select rpad(n_name, cast((select max(length(n_name)) from nation) as int), ' ') || '|' as cell from nation")
def two_pass_widths(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    width = nation.agg(F.max(F.length("n_name")).alias("w"))
    return nation.crossJoin(F.broadcast(width)).select(F.concat(F.rpad("n_name", F.col("w"), F.lit(" ")), F.lit("|")).alias("cell"))


@query()
def approximate_distinct(spark, sf_dir):
    """An estimate, so without SQL; a test holds it against the exact count."""
    return keyed.distinct_count(table(spark, sf_dir, "orders"), F.col("o_custkey"), approximate=True)
