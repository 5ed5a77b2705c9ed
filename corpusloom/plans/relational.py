"""The same operators on the star schema: best rows, rates, grouping sets, dimension joins, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, contamination, ranking, stats, validation
from .catalog import Catalog, table

CATALOG = Catalog()


@CATALOG.query("select o_custkey, versions, o_orderkey from (select o_custkey, o_orderkey, count(*) over (partition by o_custkey) as versions, row_number() over (partition by o_custkey order by o_orderdate desc, o_totalprice desc, o_orderkey desc) as r from orders) where r = 1")
def latest_order(spark, sf_dir):
    """Each customer's latest order by a composite key."""
    return ranking.best_version(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey"])


@CATALOG.query("select l_returnflag, l_linestatus, count(*) as total, count(*) filter (where l_discount > 0.05) as discounted, count(*) filter (where l_quantity > 25) as large, count(*) filter (where l_discount > 0.05) / count(*) as discounted_rate, count(*) filter (where l_quantity > 25) / count(*) as large_rate from lineitem group by 1, 2")
def line_rates(spark, sf_dir):
    return stats.rates(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") > 25})


@CATALOG.query("select o_orderstatus, o_orderpriority, concat_ws('+', case when grouping(o_orderstatus) = 0 then 'o_orderstatus' end, case when grouping(o_orderpriority) = 0 then 'o_orderpriority' end) as level, count(*) as total, count(*) filter (where o_totalprice > 100000) as dear from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def order_grouping_sets(spark, sf_dir):
    return compare.grouping_summary(table(spark, sf_dir, "orders"), [[], ["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]], {"dear": F.col("o_totalprice") > 100000})


@CATALOG.query("select r_name, n_name, count(c_custkey) as customers from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2")
def customers_by_nation(spark, sf_dir):
    """Zero-filled counts over a fixed dimension; customers are counted before they are joined."""
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(counted, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@CATALOG.query("select n_name, sum(l_quantity)::bigint as quantity, count(*) as lines from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")
def quantity_by_nation(spark, sf_dir):
    """A dimension join with lines summed by supplier before it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").join(contamination.sized_broadcast(table(spark, sf_dir, "nation"), 10_000), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.sum("q").cast("bigint").alias("quantity"), F.sum("n").alias("lines"))


@CATALOG.query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    return validation.unmatched(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@CATALOG.query("select l_shipmonth, quantile_disc(l_quantity, 0.5) as p50, quantile_disc(l_quantity, 0.95) as p95 from (select date_trunc('month', l_shipdate)::date::varchar as l_shipmonth, l_quantity from lineitem) group by 1")
def quantity_percentiles(spark, sf_dir):
    """Nearest-rank percentiles per month over counted values."""
    lines = table(spark, sf_dir, "lineitem").select(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("l_shipmonth"), "l_quantity")
    return stats.nearest_rank(lines, "l_quantity", {"p50": 0.5, "p95": 0.95}, ["l_shipmonth"])


@CATALOG.query("select p_brand, min(p_retailprice) as least, arg_min(p_partkey, (p_retailprice, p_partkey)) as least_at, max(p_retailprice) as greatest, arg_max(p_partkey, (p_retailprice, p_partkey)) as greatest_at from part group by 1")
def price_extremes(spark, sf_dir):
    return ranking.extremes(table(spark, sf_dir, "part"), F.col("p_retailprice"), "p_partkey", ["p_brand"])


@CATALOG.query("select label, count(*) as n from embeddings group by 1 order by 2 desc, 1 limit 10")
def top_labels(spark, sf_dir):
    return stats.top_values(table(spark, sf_dir, "embeddings"), "label", 10)


@CATALOG.query("select vec_id from embeddings where len(embedding) >= 64 order by vec_id limit 50")
def first_long_vectors(spark, sf_dir):
    """The first rows of at least a length, in order."""
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64).select("vec_id").orderBy("vec_id").limit(50)
