"""Row and column selection, merges, reshapes, windows and top-k queries."""

from pyspark.sql import functions as F

from colonnade.catalog.base import (
    DIRTY_SQL, DUPED_SQL, TAILED_SQL, dirty_lineitem, duped_orders, query, table, tailed_orders,
)
from colonnade.catalog.profiling import rounded
from colonnade.functions.ordering import average_ranks, positions, running_totals
from colonnade.operators import charts, clean, reshape, rows


@query("row_preview", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def _(spark, sf):
    return rows.preview(table(spark, sf, "orders"), 20, ["o_orderdate", "o_orderkey"])


@query("column_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf):
    return rows.select_columns(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])


@query("drop_constant_columns", f"""WITH d AS ({DIRTY_SQL}) SELECT l_orderkey, l_suppkey, quantity, price, discount, tax,
    returnflag, linestatus FROM d""")
def _(spark, sf):
    return rows.drop_constant_columns(dirty_lineitem(spark, sf))


@query("drop_id_columns", "SELECT event_type, value, props FROM events")
def _(spark, sf):
    return rows.drop_id_columns(table(spark, sf, "events").drop("ts"))


@query("drop_missing_columns", f"""WITH d AS ({DIRTY_SQL}) SELECT l_orderkey, l_suppkey, quantity, price, discount,
    returnflag, linestatus, fixed FROM d""")
def _(spark, sf):
    return rows.drop_missing_columns(dirty_lineitem(spark, sf), 30)


@query("filter_not_equal", f"WITH d AS ({DIRTY_SQL}) SELECT l_orderkey, quantity FROM d WHERE quantity = 10")
def _(spark, sf):
    return rows.remove_rows(dirty_lineitem(spark, sf), "quantity", "!=", 10).select("l_orderkey", "quantity")


@query("filter_greater", f"WITH d AS ({DIRTY_SQL}) SELECT l_orderkey, quantity FROM d WHERE quantity IS NULL OR quantity <= 25")
def _(spark, sf):
    return rows.remove_rows(dirty_lineitem(spark, sf), "quantity", ">", "25").select("l_orderkey", "quantity")


@query("filter_text_contains", """SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]-')""")
def _(spark, sf):
    out = rows.remove_rows(table(spark, sf, "orders"), "o_orderpriority", "contains", "^[12]-")
    return out.select("o_orderkey", "o_orderpriority")


@query("filter_is_missing", f"WITH d AS ({DIRTY_SQL}) SELECT l_orderkey, returnflag FROM d WHERE returnflag IS NOT NULL")
def _(spark, sf):
    return rows.remove_rows(dirty_lineitem(spark, sf), "returnflag", "is missing").select("l_orderkey", "returnflag")


@query("filter_matches", f"WITH d AS ({DIRTY_SQL}) SELECT count(*) AS matching FROM d WHERE linestatus >= 'O'")
def _(spark, sf):
    return rows.matching_rows(dirty_lineitem(spark, sf), "linestatus", ">=", "O").agg(F.count("*").alias("matching"))


@query("remove_rows_by_id", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN
    (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return rows.remove_rows_by_id(table(spark, sf, "orders"), "o_orderkey", ids).select("o_orderkey", "o_totalprice")


@query("row_id_lookup", """WITH i AS (SELECT DISTINCT l_partkey + 100 AS k FROM lineitem)
    SELECT count(CASE WHEN p_partkey IS NOT NULL THEN 1 END) AS valid_ids, count(CASE WHEN p_partkey IS NULL THEN 1 END)
    AS unknown_ids FROM i LEFT JOIN part ON k = p_partkey""")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").select((F.col("l_partkey") + 100).alias("k"))
    return rows.id_lookup_report(table(spark, sf, "part"), "p_partkey", ids)


@query("drop_missing_rows", f"WITH d AS ({DIRTY_SQL}) SELECT * FROM d WHERE quantity IS NOT NULL AND price IS NOT NULL")
def _(spark, sf):
    return rows.drop_missing_rows(dirty_lineitem(spark, sf), ["quantity", "price"])


@query("count_missing_rows", f"""WITH d AS ({DIRTY_SQL}) SELECT count(*) AS rows_with_missing FROM d
    WHERE quantity IS NULL OR price IS NULL OR tax IS NULL OR returnflag IS NULL""")
def _(spark, sf):
    return rows.count_missing_rows(dirty_lineitem(spark, sf))


@query("distinct_rows", f"SELECT DISTINCT * FROM ({DUPED_SQL})")
def _(spark, sf):
    return rows.distinct_rows(duped_orders(spark, sf))


@query("duplicate_preview", f"""SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey, o_orderstatus, o_totalprice, o_orderdate) AS k FROM ({DUPED_SQL})) WHERE k > 1
    ORDER BY 1, 2, 3, 4 LIMIT 20""")
def _(spark, sf):
    return rows.duplicate_preview(duped_orders(spark, sf))


@query("complete_cases", f"""WITH d AS ({DIRTY_SQL}) SELECT price, quantity, tax FROM d
    WHERE price IS NOT NULL AND quantity IS NOT NULL AND tax IS NOT NULL""")
def _(spark, sf):
    return rows.complete_cases(dirty_lineitem(spark, sf), ["price", "quantity", "tax"])


@query("case_audit", f"""WITH d AS ({DIRTY_SQL}), c AS (SELECT count(*) AS s, count(CASE WHEN price IS NOT NULL AND
    quantity IS NOT NULL AND tax IS NOT NULL THEN 1 END) AS e FROM d) SELECT s AS source_rows, e AS eligible_rows,
    s - e AS excluded_rows, round((s - e) * 100.0 / s, 6) AS excluded_percent,
    'complete cases: price, quantity, tax' AS rule FROM c""")
def _(spark, sf):
    return rounded(rows.case_audit(dirty_lineitem(spark, sf), ["price", "quantity", "tax"]), "excluded_percent")


@query("row_policy", f"""WITH d AS ({DIRTY_SQL}), c AS (SELECT count(*) AS n, count(CASE WHEN price IS NOT NULL AND tax IS NOT NULL THEN 1 END) AS k,
    sum(CASE WHEN price IS NOT NULL AND tax IS NOT NULL THEN price END) AS total FROM d)
    SELECT n AS source_rows, k AS model_rows, round(total, 2) AS price_total, round((n - k) * 100.0 / n, 6) AS excluded_percent, (n - k) * 100.0 / n > 30 AS warning FROM c""")
def _(spark, sf):
    frame, audit = rows.model_frame(dirty_lineitem(spark, sf), ["price", "tax"], "exclude")
    return frame.agg(F.lit(audit["source_rows"]).cast("long").alias("source_rows"), F.count("*").alias("model_rows"), F.round(F.sum("price"), 2).alias("price_total"),
                     F.round(F.lit(audit["excluded_percent"]), 6).alias("excluded_percent"), F.lit(audit["warning"]).alias("warning"))


@query("split_accounting", """SELECT count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS train_rows,
    count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) AS test_rows, count(*) AS eligible_rows, true AS accounted FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("split", F.expr("IF(o_orderkey % 5 = 0, 'test', 'train')"))
    return rows.split_accounting(df, "split")


@query("cleaning_impact", f"""WITH d AS ({DIRTY_SQL}), c AS (SELECT count(*) AS b, count(CASE WHEN price IS NOT NULL AND
    quantity IS NOT NULL THEN 1 END) AS a FROM d) SELECT b AS rows_before, a AS rows_after,
    round((b - a) * 100.0 / b, 6) AS lost_percent, CASE WHEN (b - a) * 100.0 / b > 30 THEN 'high'
    WHEN (b - a) * 100.0 / b > 10 THEN 'moderate' ELSE 'low' END AS band FROM c""")
def _(spark, sf):
    out = rows.cleaning_impact(dirty_lineitem(spark, sf), rows.any_missing(["price", "quantity"]))
    return rounded(out, "lost_percent")


@query("relabel_values", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
    ELSE o_orderstatus END AS label FROM orders""")
def _(spark, sf):
    out = rows.relabel(table(spark, sf, "orders"), "o_orderstatus", {"F": "finished", "O": "open"}, "label")
    return out.select("o_orderkey", "label")


MONTHLY = "SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders WHERE {w} GROUP BY 1"


@query("align_control_series", f"""SELECT strftime(a.m, '%Y-%m') AS m, round(a.v - b.v, 2) AS difference FROM
    ({MONTHLY.format(w="o_orderstatus = 'F'")}) a JOIN ({MONTHLY.format(w="o_orderstatus = 'O'")}) b ON a.m = b.m""")
def _(spark, sf):
    def monthly(status):
        df = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
        return df.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))

    out = reshape.align_difference(monthly("F"), monthly("O"), "m", "v")
    return out.select(F.date_format("m", "yyyy-MM").alias("m"), F.round("difference", 2).alias("difference"))


@query("crosstab_long", "SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS count FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return reshape.crosstab_long(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("crosstab_wide", """SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "F",
    count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "O", count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "P"
    FROM orders GROUP BY 1""")
def _(spark, sf):
    return reshape.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("unpivot_columns", """SELECT s_suppkey, 'nation' AS variable, CAST(s_nationkey AS DOUBLE) AS value FROM supplier
    UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier""")
def _(spark, sf):
    df = table(spark, sf, "supplier").selectExpr("s_suppkey", "CAST(s_nationkey AS DOUBLE) AS nation", "s_acctbal AS balance")
    return reshape.unpivot(df, ["s_suppkey"], ["nation", "balance"])


@query("pivot_mean", """SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS "F",
    round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS "O" FROM orders GROUP BY 1""")
def _(spark, sf):
    out = reshape.pivot_mean(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O"])
    return rounded(out, "F", "O", digits=2)


@query("union_group_tables", """SELECT 'priority' AS grouping, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def _(spark, sf):
    df = table(spark, sf, "orders")
    return reshape.union_tables([
        df.groupBy(F.lit(g).alias("grouping"), F.col(c).alias("level")).agg(F.count("*").alias("n"))
        for g, c in [("priority", "o_orderpriority"), ("status", "o_orderstatus")]
    ])


@query("derive_features", """SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS log_quantity,
    round(sqrt(l_extendedprice), 6) AS root_price, month(l_shipdate) AS ship_month FROM lineitem""")
def _(spark, sf):
    out = reshape.derive_columns(table(spark, sf, "lineitem"), {
        "log_quantity": F.round(F.log("l_quantity"), 6), "root_price": F.round(F.sqrt("l_extendedprice"), 6),
        "ship_month": F.month("l_shipdate")})
    return out.select("l_orderkey", "l_linenumber", "log_quantity", "root_price", "ship_month")


@query("running_total", """SELECT value, round(sum(total) OVER (ORDER BY value), 2) AS running FROM
    (SELECT l_quantity AS value, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.sum("l_extendedprice").alias("total"))
    return running_totals(sums, ["value"], {"total": "running"}).select("value", F.round("running", 2).alias("running"))


@query("group_transform_mean", """SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) AS m
    FROM lineitem""")
def _(spark, sf):
    out = clean.with_group_statistic(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "mean", "m")
    return out.select("l_orderkey", "l_linenumber", F.round("m", 4).alias("m"))


@query("group_transform_median", """SELECT l_orderkey, l_linenumber, round(median(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) AS m
    FROM lineitem""")
def _(spark, sf):
    out = clean.with_group_statistic(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "median", "m")
    return out.select("l_orderkey", "l_linenumber", F.round("m", 4).alias("m"))


@query("group_transform_mode", """WITH c AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC,
    l_quantity) AS k FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, c.l_quantity AS m FROM lineitem
    JOIN c USING (l_suppkey) WHERE k = 1""")
def _(spark, sf):
    out = clean.with_group_statistic(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "mode", "m")
    return out.select("l_orderkey", "l_linenumber", "m")


@query("average_ranks", """SELECT o_orderpriority AS value, count(*) AS count,
    (2 * sum(count(*)) OVER (ORDER BY o_orderpriority) - count(*) + 1) / 2.0 AS rank FROM orders GROUP BY 1""")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("count"))
    return average_ranks(counts, "value", "count")


@query("ordered_buckets", """SELECT floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 100 / count(*) OVER ()) AS bucket,
    o_orderkey FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", F.lit(1).cast("long").alias("one"))
    ranked = running_totals(df, ["o_orderdate", "o_orderkey"], {"one": "pos"}, grand=True)
    return ranked.select(F.floor((F.col("pos") - 1) * 100 / F.col("pos_all")).alias("bucket"), "o_orderkey")


@query("time_index", """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS time_index,
    row_number() OVER (ORDER BY ts, event_id) % 7 AS season FROM events""")
def _(spark, sf):
    out = positions(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"], name="time_index")
    return out.select("event_id", "time_index", (F.col("time_index") % 7).alias("season"))


@query("top_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return df.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(25)


@query("top_or_other", """WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
    SELECT CASE WHEN p_brand IN (FROM t) THEN p_brand ELSE 'Other' END AS brand, count(*) AS n FROM part GROUP BY 1""")
def _(spark, sf):
    return reshape.top_or_other(table(spark, sf, "part"), "p_brand", 10, "brand").groupBy("brand").agg(F.count("*").alias("n"))


@query("quantile_bins", """WITH e AS (SELECT quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM orders)
    SELECT len(list_filter(q, lambda x: x < o_totalprice)) AS bin, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi
    FROM orders, e GROUP BY 1""")
def _(spark, sf):
    out = charts.quantile_bins(table(spark, sf, "orders"), "o_totalprice", 10)
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("nearest_row", """SELECT event_id, ts FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts LIMIT 1""")
def _(spark, sf):
    return charts.nearest_row(table(spark, sf, "events"), "ts", "2024-01-15 12:00:00").select("event_id", "ts")
