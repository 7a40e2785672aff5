"""Outlier treatment and imputation queries."""

from pyspark.sql import functions as F

from colonnade.catalog.base import DIRTY_SQL, TAILED_SQL, dirty_lineitem, query, tailed_orders
from colonnade.catalog.profiling import rounded
from colonnade.operators import clean

Q = """q AS (SELECT quantile_cont(total, 0.25) AS t1, quantile_cont(total, 0.75) AS t3, quantile_cont(wave, 0.25) AS w1,
    quantile_cont(wave, 0.75) AS w3, avg(total) AS tm, stddev_samp(total) AS ts, avg(wave) AS wm, stddev_samp(wave) AS ws FROM d)"""


@query("cap_outliers_iqr", f"""WITH d AS ({TAILED_SQL}), {Q} SELECT o_orderkey, round(CASE WHEN total IS NOT NULL THEN
    least(greatest(total, t1 - 1.5 * (t3 - t1)), t3 + 1.5 * (t3 - t1)) END, 4) AS total,
    round(least(greatest(wave, w1 - 1.5 * (w3 - w1)), w3 + 1.5 * (w3 - w1)), 4) AS wave FROM d, q""")
def _(spark, sf):
    out = clean.cap_outliers_iqr(tailed_orders(spark, sf), ["total", "wave"])
    return rounded(out.select("o_orderkey", "total", "wave"), "total", "wave", digits=4)


@query("cap_outliers_zscore", f"""WITH d AS ({TAILED_SQL}), {Q} SELECT o_orderkey, round(CASE WHEN total IS NOT NULL THEN
    least(greatest(total, tm - 3 * ts), tm + 3 * ts) END, 4) AS total,
    round(least(greatest(wave, wm - 3 * ws), wm + 3 * ws), 4) AS wave FROM d, q""")
def _(spark, sf):
    out = clean.cap_outliers_zscore(tailed_orders(spark, sf), ["total", "wave"])
    return rounded(out.select("o_orderkey", "total", "wave"), "total", "wave", digits=4)


SEQ_IQR = f"""WITH d AS ({TAILED_SQL}), q1 AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM d),
    d1 AS (SELECT d.* FROM d, q1 WHERE total IS NULL OR total BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
    q2 AS (SELECT quantile_cont(wave, 0.25) AS a, quantile_cont(wave, 0.75) AS b FROM d1)
    SELECT o_orderkey, total, wave FROM d1, q2 WHERE wave BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"""


@query("remove_outliers_iqr", SEQ_IQR)
def _(spark, sf):
    return clean.remove_outliers_iqr(tailed_orders(spark, sf), ["total", "wave"]).select("o_orderkey", "total", "wave")


@query("remove_outliers_iqr_independent", f"""WITH d AS ({TAILED_SQL}), {Q} SELECT o_orderkey, total, wave FROM d, q
    WHERE (total IS NULL OR total BETWEEN t1 - 1.5 * (t3 - t1) AND t3 + 1.5 * (t3 - t1))
    AND wave BETWEEN w1 - 1.5 * (w3 - w1) AND w3 + 1.5 * (w3 - w1)""")
def _(spark, sf):
    out = clean.remove_outliers_iqr(tailed_orders(spark, sf), ["total", "wave"], sequential=False)
    return out.select("o_orderkey", "total", "wave")


@query("remove_outliers_zscore", f"""WITH d AS ({TAILED_SQL}), q1 AS (SELECT avg(total) AS m, stddev_samp(total) AS s FROM d),
    d1 AS (SELECT d.* FROM d, q1 WHERE total IS NULL OR abs(total - m) / s <= 2.5), q2 AS (SELECT avg(wave) AS m,
    stddev_samp(wave) AS s FROM d1) SELECT o_orderkey, total, wave FROM d1, q2 WHERE abs(wave - m) / s <= 2.5""")
def _(spark, sf):
    out = clean.remove_outliers_zscore(tailed_orders(spark, sf), ["total", "wave"], 2.5)
    return out.select("o_orderkey", "total", "wave")


KEYED = "l_orderkey, l_suppkey, discount"
NUMS = ["quantity", "price", "tax"]


def simple_fill(fn: str) -> str:
    return f"WITH d AS ({DIRTY_SQL}) SELECT {KEYED}, " + ", ".join(
        f"round(coalesce({c}, {fn.format(c=c)}), 4) AS {c}" for c in NUMS) + " FROM d"


for _method, _fn in [("mean", "(SELECT avg({c}) FROM d)"), ("median", "(SELECT median({c}) FROM d)"), ("zero", "0")]:

    @query(f"impute_{_method}", simple_fill(_fn))
    def _(spark, sf, method=_method):
        out = clean.impute_numeric(dirty_lineitem(spark, sf), method, NUMS)
        return rounded(out.select("l_orderkey", "l_suppkey", "discount", *NUMS), *NUMS, digits=4)


for _method, _fn in [("mean", "avg"), ("median", "median")]:

    @query(f"impute_group_{_method}", f"""WITH d AS ({DIRTY_SQL}), g AS (SELECT returnflag, {_fn}(quantity) AS gq, {_fn}(price) AS gp
    FROM d WHERE returnflag IS NOT NULL GROUP BY 1), f AS (SELECT l_orderkey, l_suppkey, coalesce(quantity, gq) AS quantity,
    coalesce(price, gp) AS price FROM d LEFT JOIN g USING (returnflag)), a AS (SELECT {_fn}(quantity) AS aq, {_fn}(price) AS ap FROM f)
    SELECT l_orderkey, l_suppkey, round(coalesce(quantity, aq), 4) AS quantity, round(coalesce(price, ap), 4) AS price FROM f, a""")
    def _(spark, sf, method=_method):
        out = clean.impute_group_numeric(dirty_lineitem(spark, sf), "returnflag", method, ["quantity", "price"])
        return rounded(out.select("l_orderkey", "l_suppkey", "quantity", "price"), "quantity", "price", digits=4)


@query("impute_mode", f"""WITH d AS ({TAILED_SQL}) SELECT o_orderkey, coalesce(status, (SELECT status FROM d WHERE status IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status FROM d""")
def _(spark, sf):
    return clean.impute_categorical(tailed_orders(spark, sf), "mode", ["status"]).select("o_orderkey", "status")


@query("impute_unknown", f"WITH d AS ({TAILED_SQL}) SELECT o_orderkey, coalesce(status, 'Unknown') AS status FROM d")
def _(spark, sf):
    return clean.impute_categorical(tailed_orders(spark, sf), "unknown", ["status"]).select("o_orderkey", "status")


@query("impute_group_mode", f"""WITH d AS ({TAILED_SQL}), m AS (SELECT priority, status AS m FROM (SELECT priority, status, row_number()
    OVER (PARTITION BY priority ORDER BY count(*) DESC, status) AS k FROM d WHERE status IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
    SELECT o_orderkey, coalesce(status, m) AS status FROM d JOIN m USING (priority)""")
def _(spark, sf):
    return clean.impute_group_mode(tailed_orders(spark, sf), "priority", ["status"]).select("o_orderkey", "status")
