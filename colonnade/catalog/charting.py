"""Chart-feeding aggregates."""

from pyspark.sql import functions as F

from colonnade.catalog.base import DIRTY_SQL, TAILED_SQL, dirty_lineitem, query, table, tailed_orders
from colonnade.catalog.profiling import rounded
from colonnade.operators import charts


@query("histogram", """WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
    b AS (SELECT range AS bin FROM range(40)), c AS (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 40) AS INT), 39) AS bin,
    count(*) AS c FROM orders, l GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * (hi - lo) / 40, 4) AS "left",
    round(lo + (b.bin + 1) * (hi - lo) / 40, 4) AS "right", coalesce(c, 0) AS count,
    round(coalesce(c, 0) / (n * (hi - lo) / 40) * 1e6, 6) AS density FROM b CROSS JOIN l LEFT JOIN c ON b.bin = c.bin""")
def _(spark, sf):
    out = charts.histogram(table(spark, sf, "orders"), "o_totalprice").withColumn("density", F.col("density") * 1e6)
    return rounded(rounded(out, "density"), "left", "right", digits=4)


@query("histogram_by_group", """WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT range AS bin FROM range(20)), g AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
    c AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - lo) / (hi - lo) * 20) AS INT), 19) AS bin,
    count(*) AS c FROM orders, l GROUP BY 1, 2) SELECT g.o_orderstatus, CAST(b.bin AS INT) AS bin, coalesce(c, 0) AS count,
    round(coalesce(c, 0) / (n * (hi - lo) / 20) * 1e6, 6) AS density FROM g CROSS JOIN b CROSS JOIN l
    LEFT JOIN c ON b.bin = c.bin AND g.o_orderstatus = c.o_orderstatus""")
def _(spark, sf):
    out = charts.histogram(table(spark, sf, "orders"), "o_totalprice", 20, ["o_orderstatus"])
    return out.select("o_orderstatus", "bin", "count", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("histogram_2d", """WITH l AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
    max(l_extendedprice) AS y1 FROM lineitem) SELECT least(CAST(floor((l_quantity - x0) / (x1 - x0) * 30) AS INT), 29) AS x_bin,
    least(CAST(floor((l_extendedprice - y0) / (y1 - y0) * 30) AS INT), 29) AS y_bin, count(*) AS count FROM lineitem, l GROUP BY 1, 2""")
def _(spark, sf):
    return charts.histogram_2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("ecdf_quantiles", """WITH o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS k FROM orders), m AS (SELECT count(*) AS n, least(count(*), 2000) AS m FROM orders),
    g AS (SELECT i, i * (n - 1) // (m - 1) AS k, (i * (n - 1) % (m - 1)) / CAST(m - 1 AS DOUBLE) AS f, m FROM m, range(2000) r(i) WHERE i < m)
    SELECT i AS point, round(i / CAST(m - 1 AS DOUBLE), 6) AS probability, round(a.x + (coalesce(b.x, a.x) - a.x) * f, 3) AS value FROM g JOIN o a ON a.k = g.k LEFT JOIN o b ON b.k = g.k + 1""")
def _(spark, sf):
    out = charts.ecdf_quantiles(table(spark, sf, "orders"), "o_totalprice")
    return out.select("point", F.round("probability", 6).alias("probability"), F.round("value", 3).alias("value"))


@query("variable_summary", f"""WITH d AS ({TAILED_SQL}) SELECT round(avg(total), 4) AS mean, round(median(total), 4) AS median,
    round(stddev_samp(total), 4) AS std, round(skewness(total), 6) AS skewness FROM d""")
def _(spark, sf):
    out = charts.variable_summary(tailed_orders(spark, sf), "total")
    return rounded(rounded(out, "skewness"), "mean", "median", "std", digits=4)


@query("box_statistics", f"""WITH d AS ({TAILED_SQL}), q AS (SELECT priority, quantile_cont(total, 0.25) AS q1, median(total) AS median,
    quantile_cont(total, 0.75) AS q3 FROM d GROUP BY 1) SELECT priority, round(q1, 4) AS q1, round(median, 4) AS median,
    round(q3, 4) AS q3, count(*) AS n, round(avg(total), 4) AS mean,
    min(CASE WHEN total >= q1 - 1.5 * (q3 - q1) THEN total END) AS whisker_low,
    max(CASE WHEN total <= q3 + 1.5 * (q3 - q1) THEN total END) AS whisker_high,
    count(CASE WHEN total < q1 - 1.5 * (q3 - q1) OR total > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers
    FROM d JOIN q USING (priority) WHERE total IS NOT NULL GROUP BY priority, q1, median, q3""")
def _(spark, sf):
    out = charts.box_statistics(tailed_orders(spark, sf), "total", ["priority"])
    return rounded(out, "q1", "median", "q3", "mean", digits=4)


@query("top_categories", f"""WITH d AS ({DIRTY_SQL}) SELECT coalesce(returnflag, 'nan') AS category, count(*) AS count,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(spark, sf):
    return rounded(charts.top_categories(dirty_lineitem(spark, sf), "returnflag"), "percent")


@query("mean_sd_by_category", f"""WITH d AS ({DIRTY_SQL}) SELECT returnflag AS category, round(avg(price), 4) AS mean,
    round(stddev_samp(price), 4) AS sd, count(price) AS n, round(stddev_samp(price) / sqrt(count(price)), 4) AS se
    FROM d WHERE returnflag IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return rounded(charts.mean_sd_by_category(dirty_lineitem(spark, sf), "returnflag", "price"), "mean", "sd", "se", digits=4)


@query("trend_line", """SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r,
    round(corr(l_extendedprice, l_quantity) ** 2, 6) AS r_squared, round(corr(l_extendedprice, l_quantity) * sqrt(count(*) - 2)
    / sqrt(1 - corr(l_extendedprice, l_quantity) ** 2), 4) AS t_statistic FROM lineitem""")
def _(spark, sf):
    out = charts.trend_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(out, "r", "r_squared"), "slope", "intercept", "t_statistic", digits=4)


@query("bounded_crosstab", """WITH a AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
    b AS (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, CAST(p_size AS VARCHAR) LIMIT 8)
    SELECT CASE WHEN p_brand IN (FROM a) THEN p_brand ELSE 'Other' END AS a,
    CASE WHEN p_size IN (FROM b) THEN CAST(p_size AS VARCHAR) ELSE 'Other' END AS b, count(*) AS count FROM part GROUP BY 1, 2""")
def _(spark, sf):
    return charts.bounded_crosstab(table(spark, sf, "part"), "p_brand", "p_size", 8)


@query("radar_means", """WITH m AS (SELECT p_brand AS category, count(*) AS n, avg(p_size) AS s, avg(p_retailprice) AS r,
    avg(p_partkey) AS k FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT category,
    round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER () + 1e-9), 6) AS p_size,
    round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER () + 1e-9), 6) AS p_retailprice,
    round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER () + 1e-9), 6) AS p_partkey FROM m""")
def _(spark, sf):
    out = charts.radar_means(table(spark, sf, "part"), "p_brand", ["p_size", "p_retailprice", "p_partkey"])
    return rounded(out, "p_size", "p_retailprice", "p_partkey")


@query("line_display", """WITH t AS (SELECT count(*) AS total FROM events), r AS (SELECT event_type AS color, ts, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    a AS (SELECT *, greatest(CAST(round_even(n * 500.0 / total, 0) AS BIGINT), 1) AS alloc FROM r, t)
    SELECT color, CAST(least(floor((pos - 1) * alloc / n), alloc - 1) AS BIGINT) AS bucket, min(ts) AS x, round(avg(value), 6) AS value
    FROM a GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(charts.line_display(table(spark, sf, "events"), "ts", ["value"], "event_id", "event_type", 500), "value")


@query("hierarchy", f"""WITH d AS ({DIRTY_SQL}) SELECT returnflag, linestatus, round(sum(price), 2) AS size FROM d
    WHERE returnflag IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC LIMIT 5000""")
def _(spark, sf):
    return rounded(charts.hierarchy(dirty_lineitem(spark, sf), ["returnflag", "linestatus"], "price"), "size", digits=2)


@query("waterfall", """WITH t AS (SELECT p_brand AS category, sum(p_retailprice) AS amount FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
    SELECT category, round(amount, 2) AS amount, round(sum(amount) OVER (ORDER BY amount DESC, category), 2) AS running_total FROM t""")
def _(spark, sf):
    return rounded(charts.waterfall(table(spark, sf, "part"), "p_brand", "p_retailprice"), "amount", "running_total", digits=2)


@query("calendar_heatmap", """SELECT monthname(o_orderdate) AS month, day(o_orderdate) AS day, round(avg(o_totalprice), 4) AS mean
    FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(charts.calendar_heatmap(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), "mean", digits=4)


@query("calendar_matrix", "SELECT monthname(o_orderdate) AS month, " + ", ".join(
    f'round(avg(CASE WHEN day(o_orderdate) = {d} THEN o_totalprice END), 4) AS "{d}"' for d in range(1, 32)) + " FROM orders GROUP BY 1")
def _(spark, sf):
    out = charts.calendar_matrix(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(out, *[str(d) for d in range(1, 32)], digits=4)


@query("display_sample")
def _(spark, sf):
    return charts.display_sample(table(spark, sf, "lineitem").withColumn(
        "row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), "row_id", 5000, "l_returnflag")
