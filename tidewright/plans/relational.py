"""Relational coverage over the star tables: scans, joins of every kind, aggregates, windows, sets, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.registry import query
from tidewright.session import table


@query("pricing_summary", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """)  # fmt: skip
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("nation_revenue", """
    SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """)  # fmt: skip
def nation_revenue(spark, sf_dir):
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count("*").alias("k"))
    met = by_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.round(F.sum("t"), 2).alias("revenue"), F.sum("k").alias("n"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("customers_with_orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_with_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("class_set_algebra", """
    SELECT 'missing' AS kind, v AS lang FROM (SELECT unnest(['en', 'it']) AS v EXCEPT SELECT lang FROM documents) UNION ALL
    SELECT 'common', v FROM (SELECT unnest(['en', 'it']) AS v INTERSECT SELECT lang FROM documents)
    """)  # fmt: skip
def class_set_algebra(spark, sf_dir):
    need = spark.createDataFrame([("en",), ("it",)], "lang string")
    have = table(spark, sf_dir, "documents").select("lang")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "lang")
    return named(need.exceptAll(have.distinct()), "missing").unionByName(named(need.intersect(have), "common"))


@query("order_rollup", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
    """)  # fmt: skip
def order_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("running_order_total", """
    SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders
    """)  # fmt: skip
def running_order_total(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_orders_per_customer(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey")


@query("latest_event_as_of_order", """
    WITH e AS (SELECT user_id, ts, event_id FROM events), o AS (SELECT o_custkey % 100 AS user_id, min(o_orderdate) + INTERVAL 10610 DAY AS at FROM orders GROUP BY 1)
    SELECT o.user_id, max(e.event_id) FILTER (WHERE e.ts = m.ts) AS event_id FROM o LEFT JOIN (SELECT o.user_id, max(e.ts) AS ts FROM o JOIN e ON e.user_id = o.user_id AND e.ts <= o.at GROUP BY 1) m ON m.user_id = o.user_id
    LEFT JOIN e ON e.user_id = o.user_id AND e.ts <= o.at GROUP BY o.user_id
    """)  # fmt: skip
def latest_event_as_of_order(spark, sf_dir):
    """The last event of a user not after a time: a union sorted by key and time carries the last event forward."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("user_id")).agg(F.expr("min(o_orderdate) + INTERVAL 10610 DAYS").alias("ts"))
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.struct("ts", "event_id").alias("e"), F.lit(False).alias("asks"))
    every = e.unionByName(o.select("user_id", "ts", F.lit(None).cast(e.schema["e"].dataType).alias("e"), F.lit(True).alias("asks")))
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    return every.withColumn("last", F.max("e").over(w)).filter("asks").select("user_id", F.col("last.event_id").alias("event_id"))


@query("events_by_value_band", """
    SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS band, count(*) AS n FROM events GROUP BY 1, 2
    """)  # fmt: skip
def events_by_value_band(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("band")).agg(F.count("*").alias("n"))


@query("conversations_assembled", """
    SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS n_turns FROM conversations GROUP BY conv_id
    """)  # fmt: skip
def conversations_assembled(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count("*").alias("n_turns"))
    said = F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return rows.select("conv_id", F.array_join(said, "\n").alias("transcript"), "n_turns")
