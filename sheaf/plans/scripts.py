"""Queries: the same results through scripts, one for each way that scripts run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.operators.ordered import record_number
from sheaf.plans.registry import query, table
from sheaf.runtime import scratch
from sheaf.script import Script
from sheaf.sources.sinks import csv_line, joined


def _events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", joined(F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("user_id") * 2).alias("line"))


@query("select event_id || '-' || upper(event_type) as line from events where event_type = 'error' and user_id > 75")
def script_stateless(spark, sf_dir):
    return Script('$3 == "error" && $2 > 75 { print $1 "-" toupper($3) }').run(_events(spark, sf_dir))


@query("select event_type || ' ' || count(*) || ' ' || cast(sum(user_id) as bigint) as line from events group by event_type")
def script_counters(spark, sf_dir):
    return Script("{ n[$3]++; s[$3] += int($2) } END { for (k in n) print k, n[k], s[k] }").run(_events(spark, sf_dir))


@query("select count(*) || ' ' || cast(sum(case when user_id % 2 = 0 then user_id else 0 end) as bigint) as line from events")
def script_totals(spark, sf_dir):
    return Script("$2 % 2 == 0 { t += int($2) } END { print NR, t }").run(_events(spark, sf_dir))


@query("select nr || ':' || event_type as line from (select *, row_number() over (order by event_id) as nr from events) where nr % 100 = 0")
def script_numbered(spark, sf_dir):
    return Script('NR % 100 == 0 { print NR ":" $3 }').run(_events(spark, sf_dir), ["event_id"])


@query("select event_id || ' - ' || event_type || ' ' || user_id * 2 as line from events where user_id % 2 = 0")
def script_field_assignment(spark, sf_dir):
    return Script('$2 % 2 == 0 { $2 = "-"; print }').run(_events(spark, sf_dir))


@query("select event_id || ' ' || replace(event_type, 'e', '[e]') || ' ' || length(event_type) - length(replace(event_type, 'e', '')) as line from events")
def script_substitution(spark, sf_dir):
    return Script('{ s = $3; n = gsub(/e/, "[&]", s); print $1, s, n }').run(_events(spark, sf_dir))


@query("select event_id || ' ' || case when user_id > 50 then 'high' when user_id > 20 then 'middle' else 'low' end as line from events")
def script_function(spark, sf_dir):
    source = 'function level(x) { if (x > 50) return "high"; if (x > 20) return "middle"; return "low" } { print $1, level(int($2)) }'
    return Script(source).run(_events(spark, sf_dir))


@query("select min(event_id) || ' ' || event_type || ' ' || user_id as line from events group by event_type, user_id")
def script_first_seen(spark, sf_dir):
    return Script("!seen[$3, $2]++ { print $1, $3, $2 }").run(_events(spark, sf_dir), ["event_id"])


@query("select event_id || ' ' || cast(sum(user_id) over (order by event_id rows unbounded preceding) as bigint) as line from events")
def script_running_total(spark, sf_dir):
    return Script("{ t += int($2); print $1, t }").run(_events(spark, sf_dir), ["event_id"])


@query("""with s as (select event_id, event_type, user_id, case when user_id % 10 = 3 then 0 when event_type = 'error' then 1 end as state from events),
o as (select *, last_value(state ignore nulls) over (order by event_id rows between unbounded preceding and 1 preceding) as open from s)
select cast(event_id as varchar) as line from o where coalesce(open, 0) = 1 or event_type = 'error' or user_id % 10 = 3""")
def script_range(spark, sf_dir):
    return Script('$3 == "error", $2 % 10 == 3 { print $1 }').run(_events(spark, sf_dir), ["event_id"])


@query("select event_id || ' ' || p as line from (select *, lag(event_type) over (order by event_id) as p from events) where p <> event_type")
def script_sequential(spark, sf_dir):
    return Script("prev != \"\" && prev != $3 { print $1, prev } { prev = $3 }").run(_events(spark, sf_dir), ["event_id"])


@query("select count(*) || ' ' || count(distinct event_type) as line from events")
def script_merged(spark, sf_dir):
    source = "function bump(m, k) { m[k]++ } { bump(seen, $3); n++ } END { for (k in seen) d++; print n, d }"
    return Script(source).run(_events(spark, sf_dir), parallel=True)


@query("select o_orderkey || ' ' || c_mktsegment as line from orders join customer on o_custkey = c_custkey where c_mktsegment <> 'BUILDING'")
def script_two_inputs(spark, sf_dir):
    """The first input is looked up by the second."""
    customer = table(spark, sf_dir, "customer").select(F.lit("customer").alias("file"), F.col("c_custkey").alias("at"), joined(F.col("c_custkey"), F.col("c_mktsegment")).alias("line"))
    orders = table(spark, sf_dir, "orders").select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("at"), joined(F.col("o_custkey"), F.col("o_orderkey")).alias("line"))
    source = 'NR == FNR { held[$1] = $2; next } $1 in held && held[$1] != "BUILDING" { print $2, held[$1] }'
    return Script(source).run(customer.unionByName(orders), ["file", "at"])


@query("with e as (select event_id, user_id, event_type from events) select (select max(user_id) from e) || ' ' || min(event_id) || ' ' || min_by(event_type, event_id) as line from e where user_id = (select max(user_id) from e)")
def script_extreme(spark, sf_dir):
    """The largest value and what stood beside its first occurrence."""
    return Script("$2 + 0 > m { m = $2 + 0; at = $1; what = $3 } END { print m, at, what }").run(_events(spark, sf_dir), ["event_id"])


@query("select cast(event_id as varchar) as line from events where event_type = 'error' union all select 'of ' || count(*) || ' ' || count(*) filter (event_type = 'error') from events")
def script_print_and_count(spark, sf_dir):
    return Script('$3 == "error" { print $1; c++ } END { print "of", NR, c }').run(_events(spark, sf_dir))


@query("select event_type as target, event_id || ' ' || user_id as line from events union all select null, cast(event_id as varchar) from events where user_id = 7")
def script_files(spark, sf_dir):
    """What print > name writes, read back, and what the same script prints plainly."""
    path = f"{scratch(spark).rstrip('/')}/sheaf-files/script-{uuid.uuid4().hex}"
    rest = Script('{ print $1, $2 > $3 } $2 == "7" { print $1 }').write(_events(spark, sf_dir), path)
    files = spark.read.text(path).select(F.col("target").cast("string").alias("target"), F.col("value").alias("line"))
    return files.unionByName(rest.select(F.lit(None).cast("string").alias("target"), "line"))


@query("select c_mktsegment || ' ' || count(*) || ' ' || cast(sum(c_custkey) as bigint) as line from customer group by c_mktsegment")
def script_field_names(spark, sf_dir):
    """Fields by the names in the first record, lines as CSV."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("at"), csv_line(F.col("c_name"), F.col("c_custkey"), F.col("c_mktsegment")).alias("line"))
    named = spark.createDataFrame([(-1, "name,key,segment")], "at bigint, line string").unionByName(rows)
    source = '{ n[$FI["segment"]]++; s[$FI["segment"]] += int($FI["key"]) } END { for (k in n) print k, n[k], s[k] }'
    return Script(source, form="csv", header=True).run(named, ["at"])


@query("select row_number() over (order by user_id, event_id || ' ' || user_id || ' ' || event_type) as nr, event_id || ' ' || user_id || ' ' || event_type as line from events")
def script_sort(spark, sf_dir):
    """Lines by the number in their second field, with their places in that order."""
    lines = Script('{ print $1, $2, $3 | "sort -n -k2,2" }').run(_events(spark, sf_dir))
    return record_number(lines.withColumn("at", F.monotonically_increasing_id()), ["at"]).drop("at")


@query("select event_id || ',\"' || event_type || ',' || user_id || '\"' as line from events")
def script_output_csv(spark, sf_dir):
    return Script('{ print $1, $3 "," $2 }', output="csv").run(_events(spark, sf_dir))
