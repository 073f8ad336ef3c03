"""Sinks as frames before and after: insert-ignore, upsert, counters, day replacement, snapshots, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswave.functions.registry import query, read
from presswave.operators import relational as R
from presswave.storage import scratch_path


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return R.insert_ignore(s.filter("s_suppkey % 2 = 0"), s.filter("s_suppkey % 3 = 0").withColumn("s_name", F.upper("s_name")), ["s_suppkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return R.upsert(s.filter("s_suppkey % 2 = 0"), s.filter("s_suppkey % 3 = 0").withColumn("s_name", F.upper("s_name")), ["s_suppkey"])


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two batches added up."""
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    count = lambda d: d.groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return R.increment(count(e.filter("event_id % 2 = 0")), count(e.filter("event_id % 2 = 1")), ["event_type", "day"], ["n"])


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def day_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily rollup whose last two days are written again: dynamic partition overwrite."""
    e = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = scratch_path(spark, "daily")
    e.filter("event_id % 3 > 0 OR day < '2024-01-20'").groupBy("event_type", "day").agg(F.count("*").alias("n")).write.partitionBy("day").parquet(path)
    late = e.filter("day >= '2024-01-20'").groupBy("event_type", "day").agg(F.count("*").alias("n"))
    late.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return spark.read.schema("event_type string, n long, day string").parquet(path).select("event_type", "day", "n")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 6")
def snapshot_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_newest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6).select("user_id", "event_id")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, greatest(c_acctbal, coalesce(m, c_acctbal)) AS best FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def counter_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denormalised counter and greatest value of each parent's children."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    out = R.refreshed_counts(read(spark, sf_dir, "customer"), o, "c_custkey", "n_orders")
    return out.join(o.groupBy("c_custkey").agg(F.max("o_totalprice").alias("m")), "c_custkey", "left").select("c_custkey", "n_orders", F.greatest("c_acctbal", "m").alias("best"))


@query("SELECT p_partkey, CASE WHEN q IS NULL THEN p_size ELSE CAST(q AS INT) END AS p_size FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON l_partkey = p_partkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("p_size"))
    return R.update_from(read(spark, sf_dir, "part").select("p_partkey", "p_size"), new, ["p_partkey"], ["p_size"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 7 = 0 AND l_linenumber = 1)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes by a list of pairs: an anti-join on both keys."""
    gone = read(spark, sf_dir, "orders").filter("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, ["l_orderkey", "l_linenumber"], "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 45 DAYS OR (o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 180 DAYS)")
def ttl_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What age limits leave, with an exempt class."""
    since = lambda days: F.expr(f"TIMESTAMP'2001-08-02 00:00:00' - INTERVAL {days} DAYS")
    at = F.col("o_orderdate").cast("timestamp")
    return read(spark, sf_dir, "orders").filter((at >= since(45)) | ((F.col("o_orderpriority") == "1-URGENT") & (at >= since(180)))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from parallel arrays: a batch insert of each order's lines, whose columns came as arrays of one length."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    sent = orders.select("l_orderkey", *(F.col(f"x.{c}").alias(c) for c in ("l_linenumber", "l_partkey", "l_quantity")))
    return sent.select("l_orderkey", F.explode(F.arrays_zip("l_linenumber", "l_partkey", "l_quantity")).alias("r")).select("l_orderkey", "r.*")
