"""Time series over orders: roll-ups, trends, anomalies, forecasts, stock levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import windows as W
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query

_DAILY = """
daily AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS revenue, sum(l_quantity) AS units, count(DISTINCT l_orderkey) AS orders
          FROM lineitem GROUP BY 1)"""


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity", "l_orderkey")
    return rows.groupBy("day").agg(F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("units"), F.countDistinct("l_orderkey").alias("orders"))


@query(f"WITH {_DAILY} SELECT day, round(revenue, 2) AS revenue, units, orders FROM daily")
def sales_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A-1: revenue, units and distinct orders a day."""
    return _daily(spark, sf).withColumn("revenue", F.round("revenue", 2))


@query(
    f"""WITH {_DAILY} SELECT round(sum(revenue), 2) AS revenue, sum(units) AS units, CAST(sum(orders) AS BIGINT) AS orders_daily_sum,
    (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders_distinct, round(sum(revenue) / greatest(sum(orders), 1), 2) AS order_value FROM daily"""
)
def sales_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A-2: totals of the days; orders both summed over days and truly distinct."""
    totals = _daily(spark, sf).agg(F.sum("revenue").alias("_r"), F.sum("units").alias("units"), F.sum("orders").alias("orders_daily_sum"))
    distinct = table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("orders_distinct"))
    return totals.join(F.broadcast(distinct)).select(
        F.round("_r", 2).alias("revenue"), "units", "orders_daily_sum", "orders_distinct", F.round(F.col("_r") / F.greatest(F.col("orders_daily_sum"), F.lit(1)), 2).alias("order_value")
    )


@query(
    f"""WITH {_DAILY}, weekly AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, round(sum(revenue), 2) AS revenue, sum(units) AS units, CAST(sum(orders) AS BIGINT) AS orders FROM daily GROUP BY 1)
    SELECT week_start, revenue, units, orders, CASE WHEN lag(revenue) OVER w > 0 THEN round((revenue - lag(revenue) OVER w) / lag(revenue) OVER w * 100, 1) END AS change_pct
    FROM weekly WINDOW w AS (ORDER BY week_start)"""
)
def sales_weekly_trend(spark: SparkSession, sf: str) -> DataFrame:
    """A-3, W-1, S-3: weeks that begin on Monday, with the change against the week before."""
    weekly = (
        _daily(spark, sf)
        .groupBy(F.to_date(F.date_trunc("week", "day")).alias("week_start"))
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("units").alias("units"), F.sum("orders").alias("orders"))
    )
    return W.percent_change(weekly, "revenue", "week_start")


@query(
    """WITH recent AS (SELECT l_partkey, l_extendedprice, l_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - 365)
    SELECT p_name AS product, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS units FROM recent JOIN part ON l_partkey = p_partkey WHERE p_name <> '' GROUP BY p_name ORDER BY revenue DESC, product LIMIT 10"""
)
def sales_top_products(spark: SparkSession, sf: str) -> DataFrame:
    """L-1, P-2: ten products with most revenue in the year up to the last day of the data."""
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("day"))
    last = rows.agg(F.max("day").alias("last"))
    recent = rows.join(F.broadcast(last)).where(F.col("day") >= F.date_sub("last", 365))
    per_part = recent.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("r"), F.sum("l_quantity").alias("u"))
    named = per_part.join(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("product")), F.col("l_partkey") == F.col("p_partkey")).where("product <> ''")
    return named.groupBy("product").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("u").alias("units")).orderBy(F.desc("revenue"), "product").limit(10)


@query(
    """SELECT p_brand AS category, round(sum(l_extendedprice), 2) AS revenue, round(100 * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 4) AS share_pct
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""
)
def sales_category_share(spark: SparkSession, sf: str) -> DataFrame:
    """A-5: percent of the total; the total is one row, not a window over all rows."""
    per = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_extendedprice").alias("r"))
        .join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("category"))
        .agg(F.sum("r").alias("r"))
    )
    return per.join(F.broadcast(per.agg(F.sum("r").alias("t")))).select("category", F.round("r", 2).alias("revenue"), F.round(100 * F.col("r") / F.col("t"), 4).alias("share_pct"))


_GLOBAL = f"""{_DAILY},
stats AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS s, count(*) AS n FROM daily),
everywhere AS (SELECT day, (revenue - m) / s AS z FROM daily, stats WHERE n >= 7 AND s > 0 AND abs((revenue - m) / s) >= 2)"""
_ROLLING = """
frame AS (SELECT day, revenue, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS s, count(revenue) OVER w AS n FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
roll AS (SELECT day, (revenue - m) / s AS z FROM frame WHERE n = 7 AND s > 0 AND abs((revenue - m) / s) >= 2)"""


def _global(spark: SparkSession, sf: str) -> DataFrame:
    return W.global_zscore(_daily(spark, sf), "revenue").where(F.abs("z") >= 2).select("day", "z", F.lit("global").alias("method"))


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing_zscore(_daily(spark, sf), "revenue", "day").where(F.abs("z") >= 2).select("day", "z", F.lit("rolling").alias("method"))


@query(f"WITH {_GLOBAL} SELECT day, round(z, 4) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind FROM everywhere")
def sales_anomaly_global(spark: SparkSession, sf: str) -> DataFrame:
    """W-3: days two deviations off the mean of all."""
    return _global(spark, sf).select("day", F.round("z", 4).alias("z"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind"))


@query(f"WITH {_DAILY}, {_ROLLING} SELECT day, round(z, 4) AS z FROM roll")
def sales_anomaly_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """W-2: days two deviations off the seven rows before."""
    return _rolling(spark, sf).select("day", F.round("z", 4).alias("z"))


@query(
    f"WITH {_GLOBAL}, {_ROLLING} SELECT day, round(z, 4) AS z, 'global' AS method FROM everywhere UNION ALL SELECT day, round(z, 4) AS z, 'rolling' AS method FROM roll WHERE day NOT IN (SELECT day FROM everywhere)"
)
def sales_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """W-4: both kinds; a rolling anomaly counts on days that are not anomalous already."""
    return W.prefer_first(_global(spark, sf), _rolling(spark, sf), "day").select("day", F.round("z", 4).alias("z"), "method")


@query(
    f"""WITH {_DAILY}, ix AS (SELECT day, revenue, CAST(row_number() OVER (ORDER BY day) - 1 AS DOUBLE) AS x FROM daily),
    fit AS (SELECT count(*) AS n, max(day) AS last, regr_slope(revenue, x) AS b, regr_intercept(revenue, x) AS a, avg(x) AS mx, regr_sxx(revenue, x) AS sxx FROM ix HAVING count(*) >= 14),
    res AS (SELECT stddev_samp(revenue - a - b * x) AS s FROM ix, fit),
    ahead AS (SELECT *, a + b * (n - 1 + step) AS mid, 1.96 * s * sqrt(1 + 1.0 / n + (n - 1 + step - mx) * (n - 1 + step - mx) / greatest(sxx, 1.0)) AS width FROM fit, res, generate_series(1, 7) AS g(step))
    SELECT CAST(last + CAST(step AS INTEGER) AS DATE) AS day, round(greatest(mid, 0.0), 2) AS forecast, round(greatest(mid - width, 0.0), 2) AS low, round(greatest(mid + width, 0.0), 2) AS high FROM ahead"""
)
def sales_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """W-5, W-6, A-15: the next seven days by a straight line, with interval."""
    return W.linear_forecast(_daily(spark, sf).select("day", "revenue"), "day", "revenue")


_STOCK = "stock AS (SELECT l_partkey AS sku, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS on_hand, CAST(p_size * 3 AS BIGINT) AS least FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_size)"


def _stock(spark: SparkSession, sf: str) -> DataFrame:
    """Returned quantity of each part as its stock, against a level derived from its size."""
    on_hand = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("long").alias("on_hand"))
    return on_hand.join(table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 3).cast("long").alias("least"), "p_retailprice"), F.col("sku") == F.col("p_partkey")).drop("p_partkey")


@query(f"WITH {_STOCK} SELECT sku, on_hand, least, CASE WHEN on_hand = 0 THEN 'CRITICAL' WHEN on_hand <= least // 2 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM stock WHERE on_hand <= least")
def stock_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """T-20: rows at or under a threshold, graded."""
    low = _stock(spark, sf).where("on_hand <= least")
    return low.select("sku", "on_hand", "least", F.when(F.col("on_hand") == 0, "CRITICAL").when(F.col("on_hand") <= F.floor(F.col("least") / 2), "HIGH").otherwise("MEDIUM").alias("level"))


@query(
    f"""WITH {_STOCK}, need AS (SELECT sku % 100 AS vendor, sku, least - on_hand AS missing, round((least - on_hand) * p_retailprice, 2) AS line_total FROM stock JOIN part ON sku = p_partkey WHERE on_hand < least)
    SELECT vendor, count(*) AS lines, CAST(sum(missing) AS BIGINT) AS units, round(sum(line_total), 2) AS total,
      '[' || string_agg('{{"sku":' || sku || ',"quantity":' || missing || '}}', ',' ORDER BY sku) || ']' AS items FROM need GROUP BY vendor"""
)
def purchase_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A-22: one row a vendor with its nested items as JSON and their totals."""
    need = _stock(spark, sf).where("on_hand < least").select((F.col("sku") % 100).alias("vendor"), "sku", (F.col("least") - F.col("on_hand")).alias("quantity"), "p_retailprice")
    need = need.withColumn("line_total", F.round(F.col("quantity") * F.col("p_retailprice"), 2))
    return need.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
        F.round(F.sum("line_total"), 2).alias("total"),
        F.to_json(F.array_sort(F.collect_list(F.struct("sku", "quantity")))).alias("items"),
    )


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1"""
)
def latest_line_per_part(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3, W-10: the last row of each key wins, by an explicit order."""
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return W.first_per_key(rows, ["l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])


@query(
    """SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, round(sum(l_extendedprice), 2) AS revenue, count(*) AS lines FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def sales_cube(spark: SparkSession, sf: str) -> DataFrame:
    """A-27: all grouping sets of two columns."""
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


@query(
    """SELECT c_mktsegment, c_custkey, round(total, 2) AS total, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(cume_dist() OVER w, 6) AS cumulative, lead(c_custkey) OVER w AS next_customer
    FROM (SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) WINDOW w AS (PARTITION BY c_mktsegment ORDER BY round(total, 2), c_custkey)"""
)
def customer_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Extra of 2.5: NTILE, CUME_DIST and LEAD inside a segment."""
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = totals.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    w = W._over(["c_mktsegment"], ["total", "c_custkey"])
    return joined.select("c_mktsegment", "c_custkey", "total", F.ntile(4).over(w).alias("quarter"), F.round(F.cume_dist().over(w), 6).alias("cumulative"), F.lead("c_custkey").over(w).alias("next_customer"))


@query(
    """SELECT n_name, count(*) AS customers, round(sum(o_totalprice), 2) AS total, CAST(count(o_orderkey) AS BIGINT) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"""
)
def star_join(spark: SparkSession, sf: str) -> DataFrame:
    """J-2: inner and left joins of a star; the dimensions are small enough to be broadcast by their size."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region").select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"), F.sum("o_totalprice").alias("t"))
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("n_name").agg(F.sum(F.greatest(F.lit(1), F.coalesce("k", F.lit(0)))).alias("customers"), F.round(F.sum("t"), 2).alias("total"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))
