"""Time-series queries on monthly order totals and on event counts."""

from pyspark.sql import functions as F

from colonnade.catalog.base import query, table, two_sided_sql
from colonnade.catalog.profiling import rounded
from colonnade.operators import sarima
from colonnade.operators import timeseries as ts

M = """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1),
    s AS (SELECT row_number() OVER (ORDER BY m) AS t, m, v AS y FROM m)"""


def monthly(spark, sf, status=None):
    df = table(spark, sf, "orders")
    if status:
        df = df.where(F.col("o_orderstatus") == status)
    return ts.series_of(df.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1000).alias("v")), "m", "v")


@query("series_preparation", "SELECT row_number() OVER (ORDER BY ts, event_id) AS t, value AS y FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("when", F.col("ts").cast("string"))
    return ts.prepare_series(df, "when", "value", "event_id").select("t", "y")


@query("series_preparation_unparsable", "SELECT row_number() OVER (ORDER BY o_orderkey) AS t, o_totalprice AS y FROM orders")
def _(spark, sf):
    return ts.prepare_series(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey").select("t", "y")


@query("moving_average", M + """, w AS (SELECT t, (avg(y) OVER a * 12 - first_value(y) OVER a * 0 + 0) AS x, y FROM s WINDOW a AS (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
    SELECT a.t, round((sum(CASE WHEN abs(b.t - a.t) = 6 THEN 0.5 ELSE 1 END * b.y)) / 12, 5) AS trend FROM s a JOIN s b ON b.t BETWEEN a.t - 6 AND a.t + 6 GROUP BY a.t HAVING count(*) = 13""")
def _(spark, sf):
    return rounded(ts.moving_average(monthly(spark, sf), 12), "trend", digits=5)


DECOMP = M + """, tr AS (SELECT a.t, sum(CASE WHEN abs(b.t - a.t) = 6 THEN 0.5 ELSE 1 END * b.y) / 12 AS trend FROM s a JOIN s b ON b.t BETWEEN a.t - 6 AND a.t + 6 GROUP BY a.t HAVING count(*) = 13),
    j AS (SELECT s.t, y, trend, (s.t - 1) % 12 AS k FROM s LEFT JOIN tr USING (t)), q AS (SELECT k, avg(y {op} trend) AS m FROM j GROUP BY 1), l AS (SELECT avg(m) AS l FROM q)
    SELECT t, round(y, 4) AS y, round(trend, 4) AS trend, round(m {op} l, 6) AS seasonal, round(y {op} trend {op} (m {op} l), 5) AS residual FROM j JOIN q USING (k), l"""


@query("decompose_additive", DECOMP.format(op="-"))
def _(spark, sf):
    out = ts.decompose(monthly(spark, sf), 12).drop("model")
    return rounded(rounded(rounded(out, "y", "trend", digits=4), "seasonal"), "residual", digits=5)


@query("decompose_multiplicative", DECOMP.format(op="/"))
def _(spark, sf):
    out = ts.decompose(monthly(spark, sf), 12, "multiplicative").drop("model")
    return rounded(rounded(rounded(out, "y", "trend", digits=4), "seasonal"), "residual", digits=5)


@query("adf_test")
def _(spark, sf):
    return ts.adf_test(monthly(spark, sf))


@query("kpss_test", M + """, e AS (SELECT t, y - avg(y) OVER () AS e, count(*) OVER () AS n FROM s), c AS (SELECT b.t - a.t AS k, sum(a.e * b.e) AS c, any_value(a.n) AS n FROM e a JOIN e b ON b.t >= a.t GROUP BY 1),
    w AS (SELECT sum(CASE WHEN k = 0 THEN c / n ELSE c / (n / 2) END) FILTER (k <= floor(n ** (2.0 / 9))) AS s0, sum(k * c / (n / 2)) FILTER (k <= floor(n ** (2.0 / 9))) AS s1, any_value(n) AS n FROM c),
    l AS (SELECT CAST(least(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)), n - 1) AS BIGINT) AS lags, n FROM w),
    r AS (SELECT sum(CASE WHEN k = 0 THEN c ELSE 2 * (1 - k / (lags + 1)) * c END) FILTER (k <= lags) / max(l.n) AS lr FROM c, l),
    p AS (SELECT sum(s * s) AS q FROM (SELECT sum(e) OVER (ORDER BY t) AS s FROM e)), z AS (SELECT q / n / n / lr AS stat, lags FROM p, l, r)
    SELECT 'kpss' AS test, round(stat, 8) AS statistic, lags, round(CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111
        WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / 0.165 ELSE 0.01 END, 8) AS p_value, stat < 0.463 AS stationary FROM z""")
def _(spark, sf):
    return rounded(ts.kpss_test(monthly(spark, sf)), "statistic", "p_value", digits=8)


@query("stationarity_verdict")
def _(spark, sf):
    return ts.stationarity(monthly(spark, sf))


@query("autocorrelation", M + """, e AS (SELECT t, y - avg(y) OVER () AS e FROM s), c AS (SELECT b.t - a.t AS lag, sum(a.e * b.e) AS c FROM e a JOIN e b ON b.t - a.t BETWEEN 0 AND 12 GROUP BY 1),
    z AS (SELECT sum(e * e) AS c0, count(*) AS n FROM e) SELECT lag, round(c / c0, 8) AS acf, round(1.96 / sqrt(n), 8) AS bound, lag > 0 AND abs(c / c0) > 1.96 / sqrt(n) AS significant FROM c, z""")
def _(spark, sf):
    return rounded(ts.acf_pacf(monthly(spark, sf), 12).drop("pacf"), "acf", "bound", digits=8)


@query("partial_autocorrelation", M + """, e AS (SELECT t, y - avg(y) OVER () AS e FROM s), z AS (SELECT sum(e * e) AS c0 FROM e), r AS (SELECT
    (SELECT sum(a.e * b.e) FROM e a JOIN e b ON b.t = a.t + 1) / c0 AS r1, (SELECT sum(a.e * b.e) FROM e a JOIN e b ON b.t = a.t + 2) / c0 AS r2 FROM z)
    SELECT 1 AS lag, round(r1, 8) AS pacf FROM r UNION ALL SELECT 2, round((r2 - r1 * r1) / (1 - r1 * r1), 8) FROM r""")
def _(spark, sf):
    return rounded(ts.acf_pacf(monthly(spark, sf), 2).where("lag > 0").select("lag", "pacf"), "pacf", digits=8)


@query("event_autocorrelation", """WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS t, value - avg(value) OVER () AS e FROM events), c AS (
    SELECT b.t - a.t AS lag, sum(a.e * b.e) AS c FROM s a JOIN s b ON b.t IN (a.t, a.t + 1, a.t + 2, a.t + 3, a.t + 4, a.t + 5) GROUP BY 1) SELECT lag, round(c / (SELECT sum(e * e) FROM s), 8) AS acf FROM c""")
def _(spark, sf):
    series = ts.prepare_series(table(spark, sf, "events"), "ts", "value", "event_id")
    return rounded(ts.acf_pacf(series, 5).select("lag", "acf"), "acf", digits=8)


@query("ljung_box", M + """, e AS (SELECT t, y - avg(y) OVER () AS e FROM s), c AS (SELECT b.t - a.t AS k, sum(a.e * b.e) AS c FROM e a JOIN e b ON b.t - a.t BETWEEN 1 AND 12 GROUP BY 1),
    z AS (SELECT sum(e * e) AS c0, count(*) AS n FROM e), q AS (SELECT l AS lag, sum(CASE WHEN k <= l THEN (c / c0) ** 2 / (n - k) END) * max(n) * (max(n) + 2) AS q FROM c, z,
    (SELECT unnest([1, 4, 12]) AS l) GROUP BY 1) SELECT lag, round(q, 6) AS q FROM q""")
def _(spark, sf):
    series = monthly(spark, sf).select("t", F.col("y").alias("e"))
    return rounded(ts.ljung_box(series).select("lag", "q"), "q")


@query("series_residual_checks")
def _(spark, sf):
    fit = ts.fit_its(monthly(spark, sf), 40)
    return ts.residual_checks(fit.design.frame.select("t", fit.residual().alias("e")))


# Segmented regression: with a break at index k the fit is a line before and another after, so coefficients follow from two simple regressions.
ITS = M + """, b AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s WHERE t <= 40), c AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s WHERE t > 40)"""


@query("its_coefficients", ITS + """ SELECT 'Intercept' AS term, round(b.a, 4) AS coefficient FROM b UNION ALL SELECT 'time_index', round(b.b, 4) FROM b
    UNION ALL SELECT 'level', round(c.a + c.b * 40 - b.a - b.b * 40, 4) FROM b, c UNION ALL SELECT 'time_after', round(c.b - b.b, 4) FROM b, c""")
def _(spark, sf):
    return rounded(ts.its_coefficients(monthly(spark, sf), 40).select("term", "coefficient"), "coefficient", digits=4)


# Every coefficient is a sum over the residuals with weights known from its own segment; lagged products of these terms give its error.
HAC = M + f""", a AS (SELECT t <= 40 AS pre, count(*) AS n, avg(t) AS mid, var_pop(t) * count(*) AS q, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s GROUP BY 1),
    e AS (SELECT t, CASE WHEN pre THEN 1 ELSE 0 END AS own, CASE WHEN pre THEN -1 ELSE 1 END AS side, a.a, a.b, (y - a.a - a.b * t) * (1.0 / n - mid * (t - mid) / q) AS u, (y - a.a - a.b * t) * (t - mid) / q AS w FROM s JOIN a ON pre = (t <= 40)),
    i AS (SELECT 'Intercept' AS term, t, own * u AS f, own * a AS c FROM e UNION ALL SELECT 'time_index', t, own * w, own * b FROM e
        UNION ALL SELECT 'level', t, side * (u + 40 * w), side * (a + 40 * b) FROM e UNION ALL SELECT 'time_after', t, side * w, side * b FROM e),
    v AS (SELECT x.term, sqrt(sum(x.f * y.f * (1 - abs(x.t - y.t) / 5.0))) AS se FROM i x JOIN i y ON x.term = y.term AND abs(x.t - y.t) <= 4 GROUP BY 1),
    c AS (SELECT term, sum(c) AS c FROM (SELECT DISTINCT term, c FROM i) GROUP BY 1), z AS (SELECT term, c, se, c / se AS z FROM c JOIN v USING (term))
    SELECT term, round(c, 3) AS coefficient, round(se, 3) AS std_error, round(z, 5) AS statistic, round({two_sided_sql("z")}, 6) AS p_value, round(c - 1.959963984540054 * se, 3) AS ci_low, round(c + 1.959963984540054 * se, 3) AS ci_high FROM z"""


@query("its_hac_errors", HAC)
def _(spark, sf):
    out = rounded(ts.its_coefficients(monthly(spark, sf), 40), "coefficient", "std_error", "ci_low", "ci_high", digits=3)
    return rounded(rounded(out, "statistic", digits=5), "p_value")


@query("its_seasonal")
def _(spark, sf):
    return ts.its_coefficients(monthly(spark, sf), 40, lag=1, season=12)


@query("its_counterfactual", ITS + """ SELECT t, round(y, 4) AS observed, round(CASE WHEN t <= 40 THEN b.a + b.b * t ELSE c.a + c.b * t END, 4) AS fitted,
    round(b.a + b.b * t, 4) AS counterfactual, round(CASE WHEN t <= 40 THEN 0 ELSE c.a + c.b * t - b.a - b.b * t END, 4) AS effect FROM s, b, c""")
def _(spark, sf):
    return rounded(ts.its_counterfactual(monthly(spark, sf), 40), "observed", "fitted", "counterfactual", "effect", digits=4)


@query("its_effect_at_end", ITS + """ SELECT t, round(c.a + c.b * t - b.a - b.b * t, 4) AS effect, round(b.a + b.b * t, 4) AS counterfactual,
    round((c.a + c.b * t - b.a - b.b * t) * 100 / (b.a + b.b * t), 6) AS relative_percent FROM s, b, c ORDER BY t DESC LIMIT 1""")
def _(spark, sf):
    return rounded(rounded(ts.its_effect_at_end(monthly(spark, sf), 40), "effect", "counterfactual", digits=4), "relative_percent")


@query("its_controlled", """WITH f AS (SELECT date_trunc('month', o_orderdate) AS m, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1000 - sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 1000 AS v
    FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY m) AS t, v AS y FROM f WHERE v IS NOT NULL), b AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s WHERE t <= 40),
    c AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s WHERE t > 40) SELECT 'level' AS term, round(c.a + c.b * 40 - b.a - b.b * 40, 4) AS coefficient FROM b, c
    UNION ALL SELECT 'time_after', round(c.b - b.b, 4) FROM b, c""")
def _(spark, sf):
    out = ts.controlled_its(monthly(spark, sf, "F"), monthly(spark, sf, "O"), 40)
    return rounded(out.where("term IN ('level', 'time_after')").select("term", "coefficient"), "coefficient", digits=4)


@query("chow_test", M + """, x AS (SELECT t <= 40 AS g, var_pop(y) * count(*) * (1 - corr(t, y) ** 2) AS r FROM s GROUP BY 1)
    SELECT round(sum(r), 2) AS ssr_full, round(sum(CASE WHEN g THEN r END), 2) AS ssr_before, round(sum(CASE WHEN NOT g THEN r END), 2) AS ssr_after FROM x""")
def _(spark, sf):
    return rounded(ts.chow_test(monthly(spark, sf), 40).select("ssr_full", "ssr_before", "ssr_after"), "ssr_full", "ssr_before", "ssr_after", digits=2)


CUT = """(SELECT {lag} AS lag, {at} AS cut_at, regr_slope(y, t) FILTER (t <= {at}) AS b0, regr_intercept(y, t) FILTER (t <= {at}) AS a0, regr_slope(y, t) FILTER (t > {at}) AS b1, regr_intercept(y, t) FILTER (t > {at}) AS a1,
        regr_syy(y, t) FILTER (t <= {at}) - regr_sxy(y, t) FILTER (t <= {at}) ** 2 / regr_sxx(y, t) FILTER (t <= {at}) + regr_syy(y, t) FILTER (t > {at}) - regr_sxy(y, t) FILTER (t > {at}) ** 2 / regr_sxx(y, t) FILTER (t > {at}) AS rss, count(*) AS n FROM s)"""
LAGS = " UNION ALL SELECT * FROM ".join(CUT.format(lag=k, at=40 + k) for k in range(4))
PLACEBOS = " UNION ALL SELECT * FROM ".join(CUT.format(lag=0, at=k) for k in (6, 11, 16, 21, 26, 31, 40))


@query("its_lag_comparison", M + f""", f AS (SELECT * FROM {LAGS}), a AS (SELECT *, n * (ln(2 * pi()) + ln(rss / n) + 1) + 8 AS aic FROM f)
    SELECT lag, round(a1 + b1 * cut_at - a0 - b0 * cut_at, 4) AS level_change, round(b1 - b0, 5) AS slope_change, round(aic, 6) AS aic, round(aic + (ln(n) - 2) * 4, 6) AS bic, aic = min(aic) OVER () AS best FROM a""")
def _(spark, sf):
    out = ts.lag_comparison(monthly(spark, sf), 40, 3).drop("level_p_value", "slope_p_value")
    return rounded(rounded(rounded(out, "level_change", digits=4), "slope_change", digits=5), "aic", "bic")


@query("its_placebo_test", M + f""", f AS (SELECT * FROM {PLACEBOS}) SELECT CASE WHEN cut_at = 40 THEN 'real' ELSE 'placebo' END AS kind, cut_at AS position, round(a1 + b1 * cut_at - a0 - b0 * cut_at, 4) AS level_change FROM f""")
def _(spark, sf):
    return rounded(ts.placebo_test(monthly(spark, sf), 40).select("kind", "position", "level_change"), "level_change", digits=4)


@query("its_influence", ITS + """, sg AS (SELECT t > 40 AS g, avg(t) AS mt, var_pop(t) * count(*) AS sxx, count(*) AS k FROM s GROUP BY 1),
    e AS (SELECT t, y - CASE WHEN t <= 40 THEN b.a + b.b * t ELSE c.a + c.b * t END AS e, 1.0 / k + (t - mt) ** 2 / sxx AS h FROM s JOIN sg ON sg.g = (t > 40), b, c),
    q AS (SELECT *, e / sqrt(s2 * (1 - h)) AS r, n FROM e, (SELECT sum(e * e) / (count(*) - 4) AS s2, count(*) AS n FROM e))
    SELECT t, round(e, 4) AS residual, round(h, 8) AS leverage, round(r * sqrt((n - 5) / (n - 4 - r * r)), 7) AS student_external, round(r * r / 4 * h / (1 - h), 8) AS cooks_distance,
           r * r / 4 * h / (1 - h) > 4.0 / n AS influential FROM q""")
def _(spark, sf):
    out = ts.its_influence(monthly(spark, sf), 40).select("t", "residual", "leverage", "student_external", "cooks_distance", "influential")
    return rounded(rounded(rounded(out, "residual", digits=4), "leverage", "cooks_distance", digits=8), "student_external", digits=7)


@query("its_autoregressive")
def _(spark, sf):
    return ts.autoregressive_its(monthly(spark, sf), 40)


@query("its_method_comparison")
def _(spark, sf):
    return ts.its_method_comparison(monthly(spark, sf), 40)


def many_series(spark, sf):
    df = table(spark, sf, "orders")
    return df.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1000).alias("v"))


@query("arima_order_search")
def _(spark, sf):
    return ts.fit_arima(many_series(spark, sf), "o_orderpriority", "m", "v", d=0)[0]


@query("arima_forecast")
def _(spark, sf):
    models, base, inno = ts.fit_arima(many_series(spark, sf), "o_orderpriority", "m", "v", d=1, order=(1, 1))
    return ts.forecast_arima(models, base, inno, 12)


BY_PRIORITY = """WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2),
    s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY m) AS t, v AS y FROM m),
    dz AS (SELECT series, t, y - lag(y) OVER (PARTITION BY series ORDER BY t) AS dy FROM s),
    k AS (SELECT series, t % 12 AS k, count(*) AS n, avg(dy) AS mu, var_pop(dy) * count(*) AS ss FROM dz WHERE dy IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT series, sum(n) AS n, sum(ss) AS wss, sum(n * mu * mu) - sum(n * mu) * sum(n * mu) / sum(n) AS bss FROM k GROUP BY 1),
    r AS (SELECT series, CASE WHEN n > 24 THEN 1 - (wss / (n - 12)) / ((wss + bss) / (n - 1)) END AS share FROM g),
    u AS (SELECT series, t, CASE WHEN share > 0.64 THEN y - lag(y, 12) OVER (PARTITION BY series ORDER BY t) ELSE y END AS u FROM s JOIN r USING (series)),
    v AS (SELECT series, t, u, lag(u) OVER w AS u1, lag(u, 2) OVER w AS u2 FROM u WHERE u IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY t)),
    l AS (SELECT series, t, 0 AS d, u AS v FROM v UNION ALL SELECT series, t, 1, u - u1 FROM v UNION ALL SELECT series, t, 2, u - 2 * u1 + u2 FROM v),
    c AS (SELECT series, d, t, v - avg(v) OVER (PARTITION BY series, d) AS e, count(*) OVER (PARTITION BY series, d) AS n FROM l WHERE v IS NOT NULL),
    p AS (SELECT *, sum(e) OVER (PARTITION BY series, d ORDER BY t) AS s, floor(3 * sqrt(n) / 13) AS lags FROM c),
    f AS (SELECT a.series, a.d, sum((1 - abs(a.t - b.t) / (a.lags + 1)) * a.e * b.e) AS lr FROM p a JOIN p b ON a.series = b.series AND a.d = b.d AND abs(a.t - b.t) <= a.lags GROUP BY 1, 2),
    q AS (SELECT series, d, sum(s * s) / max(n) / max(lr) AS kpss FROM p JOIN f USING (series, d) GROUP BY 1, 2),
    h AS (SELECT series, max(kpss) FILTER (d = 0) AS k0, max(kpss) FILTER (d = 1) AS k1, max(kpss) FILTER (d = 2) AS k2 FROM q GROUP BY 1),
    o AS (SELECT series, share, CASE WHEN share > 0.64 THEN 1 ELSE 0 END AS seasonal, k0, k1, k2, CASE WHEN k0 < 0.463 THEN 0 WHEN k1 < 0.463 THEN 1 ELSE 2 END AS d FROM h JOIN r USING (series))"""


@query("sarima_unit_roots", BY_PRIORITY + """ SELECT series, round(share, 8) AS share, seasonal AS sd, round(k0, 7) AS kpss_0, round(k1, 7) AS kpss_1, round(k2, 7) AS kpss_2, d FROM o""")
def _(spark, sf):
    base = sarima.numbered(many_series(spark, sf), "o_orderpriority", "m", "v")
    out = sarima.unit_roots(base, 12)[0]
    return rounded(rounded(out, "share", digits=8), "kpss_0", "kpss_1", "kpss_2", digits=7)


@query("sarima_ar_orders", BY_PRIORITY + """, w AS (SELECT series, t, v - CASE WHEN o.d + seasonal < 2 THEN avg(v) OVER (PARTITION BY series) ELSE 0 END AS v, o.d + seasonal < 2 AS mean
        FROM l JOIN o USING (series, d) WHERE v IS NOT NULL),
    z AS (SELECT series, mean, v, coalesce(lag(v) OVER x, 0) AS a, coalesce(lag(v, 2) OVER x, 0) AS b FROM w WINDOW x AS (PARTITION BY series ORDER BY t)),
    t2 AS (SELECT series, count(*) AS n, CAST(any_value(mean) AS INT) + 1 AS k, sum(v * v) AS vv, sum(v * a) AS va, sum(v * b) AS vb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM z GROUP BY 1),
    rs AS (SELECT series, n, k, 0 AS p, vv AS rss FROM t2 UNION ALL SELECT series, n, k, 1, vv - va * va / aa FROM t2
        UNION ALL SELECT series, n, k, 2, vv - (va * (va * bb - vb * ab) + vb * (vb * aa - va * ab)) / (aa * bb - ab * ab) FROM t2)
    SELECT series, p, n, round(rss / n, 4) AS sigma2, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * (k + p), 6) AS aic FROM rs""")
def _(spark, sf):
    out, _ = sarima.fit_sarima(many_series(spark, sf), "o_orderpriority", "m", "v", 12, max_p=2, max_q=0, max_sp=0, max_sq=0, every_order=True)
    return rounded(rounded(out.select("series", "p", "n", "sigma2", "aic"), "sigma2", digits=4), "aic", digits=6)


@query("sarima_orders")
def _(spark, sf):
    return sarima.fit_sarima(many_series(spark, sf), "o_orderpriority", "m", "v", 12)[0]


@query("sarima_forecast")
def _(spark, sf):
    models, base = sarima.fit_sarima(many_series(spark, sf), "o_orderpriority", "m", "v", 12)
    return sarima.forecast_sarima(models, base, 12)
