"""Relational operators over the star schema and the event table: joins, aggregates, windows, sets, time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.plans.registry import Registry
from quillmill.session import table
from quillmill.streaming.index import event_windows

QUERIES = Registry()
q = QUERIES.query


@q("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    """Filtered aggregate: the predicate and five columns reach the scan."""
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@q("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def local_revenue(spark, d):
    """Six-way join."""
    r = table(spark, d, "region")
    first = r.agg(F.min("r_name").alias("r_name"))
    n = table(spark, d, "nation").join(r.join(first, "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(table(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@q("""SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def customer_orders(spark, d):
    """Left join with aggregate; orders are summed before the join."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@q("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def customers_without_pending(spark, d):
    """Anti join."""
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(pending, "c_custkey", "left_anti")


@q("""SELECT DISTINCT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def orders_with_returns(spark, d):
    """Semi join."""
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left_semi")


@q("""SELECT c_mktsegment, c_custkey, c_acctbal, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def best_customers(spark, d):
    """Top three of each segment."""
    w = Window.partitionBy("c_mktsegment")
    x = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.rank().over(w.orderBy(F.desc("c_acctbal"))).cast("bigint").alias("r"), F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("n"))
    return x.filter("n <= 3").drop("n")


@q("""SELECT n_regionkey, s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, s_nationkey)""")
def supplier_rollup(spark, d):
    """Roll-up over region and nation."""
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.rollup("n_regionkey", "s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))


@q("""SELECT p_partkey FROM part WHERE p_size < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def small_bulk_parts(spark, d):
    """Set intersection."""
    return table(spark, d, "part").filter("p_size < 10").select("p_partkey").intersect(table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@q("""SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40""")
def parts_not_returned_in_bulk(spark, d):
    """Set difference."""
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").filter("l_returnflag = 'A' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")))


@q("""SELECT time_bucket(INTERVAL '60 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_hours(spark, d):
    """Tumbling windows; the same function runs on a stream with a watermark."""
    return event_windows(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@q("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL) GROUP BY user_id""")
def event_sessions(spark, d):
    """Sessions by a running count of gaps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    x = e.withColumn("new", F.when(gap.isNull() | (gap > F.expr("INTERVAL '6' HOUR")), 1).otherwise(0)).withColumn("s", F.sum("new").over(w))
    return x.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@q("""SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY user_id""")
def event_latest(spark, d):
    """Latest row of each key by an aggregate, without a sort."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


@q("""SELECT e.event_id, p.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) e ASOF LEFT JOIN (SELECT DISTINCT ON (user_id, ts) * FROM (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY event_id DESC)) p ON e.user_id = p.user_id AND e.ts > p.ts""")
def event_asof(spark, d):
    """As-of join by one window over the union, instead of a range join."""
    e = table(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    x = e.select("event_id", "user_id", "ts", "event_type").crossJoin(F.broadcast(ends)).filter("event_type = lo OR event_type = hi")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # At one time the left side sees only what came before it: the right side is moved one microsecond on.
    moved = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_type") == F.col("lo"), 1).otherwise(0)
    x = x.withColumn("t", moved).withColumn("p", F.when(F.col("event_type") == F.col("lo"), F.struct("t", "event_id")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("last", F.max("p").over(w)).filter("event_type = hi").select("event_id", F.col("last.event_id").alias("before_id"))


@q("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count_if(value > 50) AS high, round(stddev_pop(value), 5) AS sd, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type""")
def event_statistics(spark, d):
    """Distinct, conditional and ordered aggregates."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.stddev_pop("value"), 5).alias("sd"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"))
