"""Queries over real files: tables written as text, CSV and TSV into the checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.operators import ordered
from sheaf.plans.registry import query, table
from sheaf.runtime import scratch
from sheaf.sources import readers, sinks


def _path(spark, name):
    return f"{scratch(spark).rstrip('/')}/sheaf-files/{name}-{uuid.uuid4().hex}"


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def csv_scan(spark, sf_dir):
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), path := _path(spark, "orders"))
    c = readers.csv(spark, path)
    return c.select(F.col("_c0").cast("bigint").alias("o_orderkey"), F.col("_c1").cast("bigint").alias("o_custkey"), F.col("_c2").alias("o_orderstatus"), F.col("_c3").alias("o_orderpriority"))


@query("select doc_id, text, source from documents where text is not null and position(chr(92) in text) = 0 union all select doc_id, null, source from documents where text is null or position(chr(92) in text) > 0")
def csv_scan_of_texts(spark, sf_dir):
    """Texts with commas, quotes and newlines, through quoted fields; those that the format does not keep (null, backslashes) as null."""
    kept = F.when(~F.contains("text", F.lit("\\")), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", kept.isNotNull().cast("int").alias("there"), kept.alias("text"), "source")
    sinks.write_csv(docs, path := _path(spark, "documents"))
    f = readers.lines(spark, path, "\r\n").select(readers.csv_fields(F.col("line")).alias("f"))
    return f.select(F.get("f", 0).cast("bigint").alias("doc_id"), F.when(F.get("f", 1) == "1", F.get("f", 2)).alias("text"), F.get("f", 3).alias("source"))


@query("select c_custkey, c_name, c_mktsegment from customer")
def csv_scan_header(spark, sf_dir):
    """Columns named by the first record."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customer.write.option("header", True).option("escape", '"').csv(path := _path(spark, "customer"))
    c = readers.csv(spark, path, header=True)
    return c.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment")


@query("select event_id, event_type, props from events")
def tsv_scan(spark, sf_dir):
    sinks.write_tsv(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), path := _path(spark, "events"))
    c = readers.tsv(spark, path, 3)
    return c.select(F.col("_c0").cast("bigint").alias("event_id"), F.col("_c1").alias("event_type"), F.col("_c2").alias("props"))


@query("select split_part(event_type, '/', 1) as file, count(*) as n, cast(sum(event_id) as bigint) as total from events group by all")
def text_scan_of_files(spark, sf_dir):
    """A file for each target of print > target, read back as several inputs whose records know their file."""
    events = table(spark, sf_dir, "events")
    sinks.write_targets(events, sinks.joined(F.col("event_id"), F.col("user_id")), F.col("event_type"), path := _path(spark, "targets"))
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]  # names of the targets
    df = readers.with_fields(readers.lines(spark, [f"{path}/target={k}" for k in kinds]))
    name = F.regexp_extract("file", "target=([^/]*)", 1)
    return df.groupBy(name.alias("file")).agg(F.count("*").alias("n"), F.sum(F.get("fields", 0).cast("bigint")).alias("total"))


@query("select nr, word from (select row_number() over (order by p_partkey) as nr, p_type as word from part)")
def text_scan_regex_records(spark, sf_dir):
    """Records that a regular expression separates, numbered in the order of the file."""
    part = table(spark, sf_dir, "part")
    one = part.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda x: F.concat(x["p_type"], F.repeat(F.lit(";"), (1 + x["p_partkey"] % 3).cast("int")))), "").alias("value"))
    one.coalesce(1).write.text(path := _path(spark, "separated"))
    return readers.records(spark, path, ";+").where("line <> chr(10)").select((F.col("pos") + 1).cast("bigint").alias("nr"), F.regexp_replace("line", "\\n$", "").alias("word"))


@query("select event_id, lag(value_or_null) over (order by event_id) as before, lead(value_or_null) over (order by event_id) as after from (select event_id, case when user_id % 3 = 0 then event_type end as value_or_null from events)")
def neighbours_with_nulls(spark, sf_dir):
    """Values of the records before and after, null where theirs are, wherever partitions end."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("v"))
    both = ordered.next_record(ordered.previous_record(events, ["event_id"], F.col("v"), name="before"), ["event_id"], F.col("v"), name="after")
    return both.drop("v")
