"""Regression queries. SQL checks use closed forms: two-predictor normal equations and saturated categorical models."""

from pyspark.sql import functions as F

from colonnade.catalog.base import DIRTY_SQL, dirty_lineitem, logistic_ctes, query, table, two_sided_sql
from colonnade.catalog.profiling import rounded
from colonnade.catalog.testing import shapiro_sql
from colonnade.operators import absorb, glm, linear

# Two-predictor least squares from centred moments; y ~ a + b.
OLS2 = """m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa,
    var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby,
    var_pop(y) * count(*) AS syy FROM d), f AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM m), g AS (SELECT *, my - ba * ma - bb * mb AS b0,
    syy - ba * say - bb * sby AS rss, saa * sbb - sab * sab AS det FROM f)"""
D2 = "WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem), " + OLS2


def price_fit(spark, sf, **options):
    return linear.fit_ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], **options)


@query("ols_coefficients", D2 + """ SELECT 'l_quantity' AS term, round(ba, 4) AS coefficient, round(sqrt(rss / (n - 3) * sbb / det), 5) AS std_error,
    round(ba / sqrt(rss / (n - 3) * sbb / det), 4) AS statistic FROM g
    UNION ALL SELECT 'l_discount', round(bb, 4), round(sqrt(rss / (n - 3) * saa / det), 5), round(bb / sqrt(rss / (n - 3) * saa / det), 4) FROM g
    UNION ALL SELECT 'Intercept', round(b0, 4), round(sqrt(rss / (n - 3) * (1 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)), 5),
    round(b0 / sqrt(rss / (n - 3) * (1 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)), 4) FROM g""")
def _(spark, sf):
    fit = price_fit(spark, sf)
    out = linear.coefficients(table(spark, sf, "lineitem"), fit).select("term", "coefficient", "std_error", "statistic")
    return rounded(rounded(out, "coefficient", "statistic", digits=4), "std_error", digits=5)


@query("ols_fit_statistics", D2 + """ SELECT CAST(n AS BIGINT) AS n, round(1 - rss / syy, 6) AS r_squared,
    round(1 - rss / syy * (n - 1) / (n - 3), 6) AS adj_r_squared, round((syy - rss) / 2 / (rss / (n - 3)), 3) AS f_statistic,
    round(-n / 2 * (ln(2 * pi()) + ln(rss / n) + 1), 3) AS log_likelihood, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 6, 3) AS aic,
    round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 3 * ln(n), 3) AS bic, round(sqrt(rss / (n - 3)), 4) AS sigma FROM g""")
def _(spark, sf):
    out = linear.fit_statistics(table(spark, sf, "lineitem"), price_fit(spark, sf)).drop("f_p_value")
    out = rounded(out, "r_squared", "adj_r_squared")
    return rounded(rounded(out, "f_statistic", "log_likelihood", "aic", "bic", digits=3), "sigma", digits=4)


@query("ols_categorical", """WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, CAST(count(*) AS DOUBLE) AS n, var_pop(o_totalprice) * count(*) AS s
    FROM orders GROUP BY 1), t AS (SELECT sum(s) / (sum(n) - 5) AS s2 FROM g), r AS (SELECT m AS m1, n AS n1 FROM g ORDER BY p LIMIT 1)
    SELECT CASE WHEN p = '1-URGENT' THEN 'Intercept' ELSE 'o_orderpriority[T.' || p || ']' END AS term,
    round(CASE WHEN p = '1-URGENT' THEN m ELSE m - m1 END, 3) AS coefficient,
    round(sqrt(s2 * CASE WHEN p = '1-URGENT' THEN 1 / n ELSE 1 / n + 1 / n1 END), 4) AS std_error FROM g, t, r""")
def _(spark, sf):
    df = table(spark, sf, "orders")
    out = linear.coefficients(df, linear.fit_ols(df, "o_totalprice", ["o_orderpriority"])).select("term", "coefficient", "std_error")
    return rounded(rounded(out, "coefficient", digits=3), "std_error", digits=4)


@query("ols_log_outcome", """SELECT round(regr_slope(ln(o_totalprice), o_custkey) * 1e6, 5) AS slope, round(regr_intercept(ln(o_totalprice), o_custkey), 6) AS intercept FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders")
    fit = linear.fit_ols(df, "o_totalprice", ["o_custkey"], transform="log")
    c = {r["term"]: r["coefficient"] for r in linear.coefficients(df, fit).collect()}
    return spark.createDataFrame([(c["o_custkey"] * 1e6, c["Intercept"])], "slope double, intercept double").select(
        F.round("slope", 5).alias("slope"), F.round("intercept", 6).alias("intercept"))


SQ = """WITH c AS (SELECT avg(l_quantity) AS c FROM lineitem), d AS (SELECT l_extendedprice AS y, l_quantity AS a, (l_quantity - c) ** 2 AS b
    FROM lineitem, c), """ + OLS2


@query("ols_centred_square", SQ + """ SELECT 'l_quantity' AS term, round(ba, 4) AS coefficient FROM g UNION ALL SELECT 'l_quantity^2', round(bb, 5) FROM g
    UNION ALL SELECT 'Intercept', round(b0, 3) FROM g""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = linear.coefficients(df, linear.fit_ols(df, "l_extendedprice", ["l_quantity"], squares=["l_quantity"]))
    digits = F.when(F.col("term") == "l_quantity^2", F.round("coefficient", 5)).when(
        F.col("term") == "Intercept", F.round("coefficient", 3)).otherwise(F.round("coefficient", 4))
    return out.select("term", digits.alias("coefficient"))


@query("ols_interaction", """WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_linestatus AS s FROM lineitem), f AS (SELECT
    regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE s = 'F'), o AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE s = 'O')
    SELECT 'Intercept' AS term, round(f.a, 3) AS coefficient FROM f UNION ALL SELECT 'l_quantity', round(f.b, 3) FROM f
    UNION ALL SELECT 'l_linestatus[T.O]', round(o.a - f.a, 3) FROM f, o UNION ALL SELECT 'l_quantity:l_linestatus[T.O]', round(o.b - f.b, 3) FROM f, o""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    fit = linear.fit_ols(df, "l_extendedprice", ["l_quantity", "l_linestatus"], interactions=[("l_quantity", "l_linestatus")])
    return rounded(linear.coefficients(df, fit).select("term", "coefficient"), "coefficient", digits=3)


@query("ols_nested_comparison", D2 + """, r AS (SELECT g.*, syy - say * say / saa AS rss1 FROM g) SELECT 1 AS df_added, CAST(n - 3 AS BIGINT) AS df_resid,
    round((rss1 - rss) / (rss / (n - 3)), 5) AS f, round((rss1 - rss) / syy, 9) AS delta_r_squared, round(n * ln(rss / rss1) + 2, 4) AS delta_aic,
    round(n * ln(rss / rss1) + ln(n), 4) AS delta_bic FROM r""")
def _(spark, sf):
    out = linear.compare_nested(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_quantity", "l_discount"])
    out = rounded(rounded(out.drop("p_value"), "f", digits=5), "delta_r_squared", digits=9)
    return rounded(out, "delta_aic", "delta_bic", digits=4)


@query("ols_train_test_metrics")
def _(spark, sf):
    df = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return linear.train_test_ols(df, "o_totalprice", ["c_acctbal", "o_orderstatus"], "o_orderkey")[2]


@query("regression_metrics", """SELECT l_returnflag, count(*) AS n, round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r_squared,
    round(avg((l_extendedprice - 1500 * l_quantity) ** 2), 1) AS mse, round(sqrt(avg((l_extendedprice - 1500 * l_quantity) ** 2)), 4) AS rmse,
    round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) AS mae FROM lineitem GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("guess", 1500 * F.col("l_quantity"))
    out = linear.regression_metrics(df, "l_extendedprice", "guess", ["l_returnflag"])
    return rounded(rounded(rounded(out, "r_squared"), "mse", digits=1), "rmse", "mae", digits=4)


@query("ols_score_rows", """WITH t AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem WHERE l_linestatus = 'F'), m AS (SELECT count(*) AS n,
    regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) * (1 - corr(x, y) ** 2) AS rss FROM t)
    SELECT l_quantity, count(*) AS n, round(max(a + b * l_quantity), 2) AS predicted FROM lineitem, m WHERE l_linestatus = 'O' GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    fit = linear.fit_ols(df.where("l_linestatus = 'F'"), "l_extendedprice", ["l_quantity"])
    out = linear.score_rows(df.where("l_linestatus = 'O'"), fit)
    return out.groupBy("l_quantity").agg(F.count("*").alias("n"), F.round(F.max("predicted"), 2).alias("predicted"))


@query("extrapolation_flags", """WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, o_totalprice < lo OR o_totalprice > hi AS extrapolated FROM orders, l WHERE o_orderstatus = 'O'""")
def _(spark, sf):
    df = table(spark, sf, "orders")
    out = linear.extrapolation_flags(df.where("o_orderstatus = 'O'"), df.where("o_orderstatus = 'P'"), ["o_totalprice"])
    return out.select("o_orderkey", "extrapolated")


@query("variance_inflation", """WITH d AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT term, round(1 / (1 - r * r), 6) AS vif,
    'ok' AS status FROM d, (VALUES ('l_quantity'), ('l_extendedprice')) t(term)""")
def _(spark, sf):
    return rounded(linear.variance_inflation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), "vif")


SIMPLE = """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y, l_quantity AS x FROM lineitem), m AS (SELECT CAST(count(*) AS DOUBLE) AS n,
    regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM d),
    e AS (SELECT d.*, n, mx, sxx, y - a - b * x AS e, 1 / n + (x - mx) ** 2 / sxx AS h, a, b FROM d, m),
    s AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM e)"""


def simple_fit(spark, sf):
    df = table(spark, sf, "lineitem")
    keys = {k: F.col(k) for k in ["l_orderkey", "l_linenumber", "l_partkey"]}
    return linear.fit_ols(df, "l_extendedprice", ["l_quantity"], carry=keys)


@query("breusch_pagan", SIMPLE + """ SELECT round(corr(e * e, x) ** 2 * count(*), 3) AS lm, 1 AS df FROM e""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(linear.breusch_pagan(df, simple_fit(spark, sf)).drop("p_value"), "lm", digits=3)


@query("robust_hc3", SIMPLE + """, v AS (SELECT sum((x - mx) ** 2 * (e / (1 - h)) ** 2) / max(sxx) ** 2 AS vb,
    sum((1 / n - mx * (x - mx) / sxx) ** 2 * (e / (1 - h)) ** 2) AS va FROM e)
    SELECT 'Intercept' AS term, round(sqrt(va), 5) AS std_error_hc3 FROM v UNION ALL SELECT 'l_quantity', round(sqrt(vb), 5) FROM v""")
def _(spark, sf):
    out = linear.robust_comparison(table(spark, sf, "lineitem"), simple_fit(spark, sf))
    return out.select("term", F.round("std_error_hc3", 5).alias("std_error_hc3"))


@query("ols_influence", SIMPLE + """ SELECT l_orderkey, l_linenumber, l_partkey, round(e, 2) AS residual, round(h, 8) AS leverage,
    round(e / sqrt(s2 * (1 - h)), 5) AS student_internal,
    round(e / sqrt(s2 * (1 - h)) * sqrt((n - 3) / (n - 2 - (e / sqrt(s2 * (1 - h))) ** 2)), 5) AS student_external,
    round(e * e * h / (2 * s2 * (1 - h) ** 2), 9) AS cooks_distance, e * e * h / (2 * s2 * (1 - h) ** 2) > 4 / n AS influential,
    h > 4 / n AS high_leverage FROM e, s""")
def _(spark, sf):
    out = linear.influence(simple_fit(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey"])
    out = out.select("l_orderkey", "l_linenumber", "l_partkey", "residual", "leverage", "student_internal", "student_external",
                     "cooks_distance", "influential", "high_leverage")
    out = rounded(rounded(out, "residual", digits=2), "student_internal", "student_external", digits=5)
    return rounded(rounded(out, "leverage", digits=8), "cooks_distance", digits=9)


@query("ols_dfbetas", SIMPLE + """, k AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(abs((1 / n - mx * (x - mx) / sxx) * e / (sqrt(s2) * (1 - h))),
    abs((x - mx) / sxx * e / (sqrt(s2) * (1 - h)))) AS d, n FROM e, s) SELECT l_orderkey, l_linenumber, l_partkey, round(d, 7) AS max_abs_dfbetas,
    d > 2 / sqrt(n) AS dfbetas_flag FROM k""")
def _(spark, sf):
    out = linear.influence(simple_fit(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "max_abs_dfbetas", "dfbetas_flag"), "max_abs_dfbetas", digits=7)


@query("bonferroni_outliers", """WITH o AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice * 30 ELSE o_totalprice END AS y FROM orders),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, regr_slope(y, x) AS b, count(*) AS n FROM o),
    e AS (SELECT o_orderkey, y - my - b * (x - mx) AS e, 1.0 / n + (x - mx) ** 2 / sxx AS h, n FROM o, m), s AS (SELECT sum(e * e) / (count(*) - 2) AS s2 FROM e),
    t AS (SELECT *, e / sqrt(s2 * (1 - h)) AS t FROM e, s), r AS (SELECT *, t * sqrt((n - 3) / (n - 2 - t * t)) AS st FROM t)
    SELECT o_orderkey, round(st, 6) AS student_external, round(t * t / 2 * h / (1 - h), 8) AS cooks_distance FROM r WHERE abs(st) > 5""")
def _(spark, sf):
    """The far residuals of the data lie beyond 10, the others below 2, so the check needs no tail probability."""
    df = table(spark, sf, "orders").withColumn("total", F.expr("IF(o_orderkey % 997 = 0, o_totalprice * 30, o_totalprice)"))
    out = linear.bonferroni_outliers(linear.fit_ols(df, "total", ["o_custkey"], carry={"o_orderkey": F.col("o_orderkey")}), ["o_orderkey"])
    return rounded(rounded(out.select("o_orderkey", "student_external", "cooks_distance"), "student_external"), "cooks_distance", digits=8)


@query("refit_without_influential", SIMPLE + """, k AS (SELECT d.* FROM e d, s WHERE e * e * h / (2 * s2 * (1 - h) ** 2) <= 4 / n),
    r AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS a1, count(*) AS n1 FROM k)
    SELECT 'Intercept' AS term, round(a, 3) AS coefficient_all, round(a1, 3) AS coefficient_reduced, CAST(n - n1 AS BIGINT) AS rows_removed FROM m, r
    UNION ALL SELECT 'l_quantity', round(b, 3), round(b1, 3), CAST(n - n1 AS BIGINT) FROM m, r""")
def _(spark, sf):
    out = linear.refit_without_influential(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    out = out.select("term", "coefficient_all", "coefficient_reduced", F.col("rows_removed").cast("long").alias("rows_removed"))
    return rounded(out, "coefficient_all", "coefficient_reduced", digits=3)


@query("ols_health_checklist", D2 + """, e AS (SELECT (y - b0 - ba * a - bb * b) ** 2 AS u, a, b, rss / (n - 3) AS s2, n,
    1 / n + (sbb * (a - ma) ** 2 - 2 * sab * (a - ma) * (b - mb) + saa * (b - mb) ** 2) / det AS h FROM d, g),
    w AS (SELECT covar_pop(a, u) AS ua, covar_pop(b, u) AS ub, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, var_pop(u) AS uu, count(*) AS n,
    count(CASE WHEN u * h / (3 * s2 * (1 - h) ** 2) > 4.0 / n THEN 1 END) AS far FROM e),
    c AS (SELECT 1 / (1 - ab * ab / (aa * bb)) AS vif, exp(-n * (ua * (bb * ua - ab * ub) + ub * (aa * ub - ab * ua)) / (aa * bb - ab * ab) / uu / 2) AS p, far FROM w)
    SELECT 'multicollinearity' AS "check", round(vif, 6) AS value, CASE WHEN vif > 10 THEN 'problem' WHEN vif > 5 THEN 'warning' ELSE 'passed' END AS status FROM c
    UNION ALL SELECT 'homoscedasticity', round(p, 6), CASE WHEN p < 0.05 THEN 'problem' ELSE 'passed' END FROM c
    UNION ALL SELECT 'influential rows', far, CASE WHEN far > 0 THEN 'warning' ELSE 'passed' END FROM c""")
def _(spark, sf):
    return rounded(linear.health_checklist(table(spark, sf, "lineitem"), price_fit(spark, sf)), "value")


@query("residual_normality", shapiro_sql("""SELECT y - (my + b * (x - mx)) AS x FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem),
    (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)"""))
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = linear.residual_normality(df, linear.fit_ols(df, "l_extendedprice", ["l_quantity"]))
    return rounded(out.select("n", "statistic"), "statistic")


@query("durbin_watson", """WITH d AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    e AS (SELECT row_number() OVER (ORDER BY m) AS t, v - avg(v) OVER () AS e FROM d), s AS (SELECT e, e - lag(e) OVER (ORDER BY t) AS s FROM e)
    SELECT round(sum(s * s) / sum(e * e), 6) AS durbin_watson FROM s""")
def _(spark, sf):
    from colonnade.functions.ordering import positions
    m = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    mean = m.agg(F.avg("v").alias("mu"))
    e = positions(m, ["m"], name="t").join(F.broadcast(mean)).select("t", (F.col("v") - F.col("mu")).alias("e"))
    return rounded(linear.durbin_watson(e, "e", "t"), "durbin_watson")


# A t value is significant beyond the normal quantile and its first correction for the degrees of freedom.
@query("coefficient_sentences", D2 + """, t AS (SELECT 'l_quantity' AS term, ba AS c, sqrt(rss / (n - 3) * sbb / det) AS se, n FROM g UNION ALL SELECT 'l_discount', bb, sqrt(rss / (n - 3) * saa / det), n FROM g)
    SELECT term, printf('one unit more of %s goes with %.4f %s price (%s)', term, abs(c), CASE WHEN c > 0 THEN 'higher' ELSE 'lower' END,
    CASE WHEN abs(c / se) > 1.959964 + 2.3723 / (n - 3) THEN 'significant' ELSE 'not significant' END) AS sentence FROM t""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return linear.coefficient_sentences(linear.coefficients(df, price_fit(spark, sf)), "price")


# Saturated logistic model: urgent or high priority by order status.
URGENT = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'calm' END"
LOGIT = f"""WITH d AS (SELECT CASE WHEN {URGENT} = 'urgent' THEN 1.0 ELSE 0.0 END AS y, o_orderstatus AS s FROM orders), g AS (SELECT s, count(*) * 1.0 AS n,
    sum(y) AS k, avg(y) AS p FROM d GROUP BY 1), r AS (SELECT n AS n1, k AS k1, p AS p1 FROM g WHERE s = 'F'), t AS (SELECT sum(n) AS n, sum(k) / sum(n) AS p,
    sum(k * ln(p) + (n - k) * ln(1 - p)) AS ll FROM g)"""


def urgent_fit(spark, sf):
    df = table(spark, sf, "orders").withColumn("urgency", F.expr(URGENT))
    return df, glm.fit_glm(df, "urgency", ["o_orderstatus"], "binomial", carry={"o_orderkey": F.col("o_orderkey"), "o_orderstatus": F.col("o_orderstatus")})


@query("logistic_coefficients", LOGIT + """ SELECT CASE WHEN s = 'F' THEN 'Intercept' ELSE 'o_orderstatus[T.' || s || ']' END AS term,
    round(CASE WHEN s = 'F' THEN ln(p / (1 - p)) ELSE ln(p / (1 - p)) - ln(p1 / (1 - p1)) END, 6) AS coefficient,
    round(sqrt(1 / k + 1 / (n - k) + CASE WHEN s = 'F' THEN 0 ELSE 1 / k1 + 1 / (n1 - k1) END), 6) AS std_error,
    round(exp(CASE WHEN s = 'F' THEN ln(p / (1 - p)) ELSE ln(p / (1 - p)) - ln(p1 / (1 - p1)) END), 6) AS ratio FROM g, r""")
def _(spark, sf):
    df, fit = urgent_fit(spark, sf)
    return rounded(glm.coefficients(df, fit).select("term", "coefficient", "std_error", "ratio"), "coefficient", "std_error", "ratio")


@query("logistic_fit_statistics", LOGIT + """ SELECT CAST(n AS BIGINT) AS n, round(ll, 4) AS log_likelihood, round(-2 * ll + 6, 4) AS aic, round(-2 * ll + 3 * ln(n), 4) AS bic,
    round(-2 * ll, 4) AS deviance, round(-2 * n * (p * ln(p) + (1 - p) * ln(1 - p)), 4) AS null_deviance,
    round((1 - ll / (n * (p * ln(p) + (1 - p) * ln(1 - p)))) * 100, 6) AS deviance_reduction_percent,
    round(1 - ll / (n * (p * ln(p) + (1 - p) * ln(1 - p))), 8) AS mcfadden_r2 FROM t""")
def _(spark, sf):
    df, fit = urgent_fit(spark, sf)
    out = glm.fit_statistics(df, fit).drop("pearson_chi2_df")
    out = rounded(out, "log_likelihood", "aic", "bic", "deviance", "null_deviance", digits=4)
    return rounded(rounded(out, "deviance_reduction_percent"), "mcfadden_r2", digits=8)


def logistic_sql(rows, terms, scale, steps=8):
    """SQL of a logistic model: ``rows`` holds y and x0.. (x0 is 1), ``scale`` divides each coefficient."""
    parts = [f"rows AS ({rows})", *logistic_ctes("rows", len(terms), steps)]
    out = " UNION ALL ".join(
        f"SELECT '{t}' AS term, round(x{i} / {c}, 7) AS coefficient, round(sqrt(v{i}) / {c}, 7) AS std_error, round({two_sided_sql(f'x{i} / sqrt(v{i})')}, 6) AS p_value FROM n{steps}, var"
        for i, (t, c) in enumerate(zip(terms, scale, strict=True)))
    return f"WITH {', '.join(parts)} {out}"


@query("logistic_continuous", logistic_sql("SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, 1.0 AS x0, CAST(l_quantity AS DOUBLE) / 10 AS x1, CAST(l_discount AS DOUBLE) AS x2, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END AS x3 FROM lineitem",
    ["Intercept", "l_quantity", "l_discount", "l_linestatus[T.O]"], [1, 10, 1, 1]))
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("late", F.expr("IF(l_returnflag = 'R', 1, 0)"))
    out = glm.coefficients(df, glm.fit_glm(df, "late", ["l_quantity", "l_discount", "l_linestatus"], "binomial"))
    return rounded(rounded(out.select("term", "coefficient", "std_error", "p_value"), "coefficient", "std_error", digits=7), "p_value")


@query("probability_metrics", LOGIT + """, x AS (SELECT d.y, g.p FROM d JOIN g USING (s)), c AS (SELECT p, count(*) AS n, sum(y) AS k FROM x GROUP BY 1),
    a AS (SELECT sum(u.k * ((v.n - v.k) * CASE WHEN u.p > v.p THEN 1 WHEN u.p = v.p THEN 0.5 ELSE 0 END)) / (sum(DISTINCT 0) + (SELECT sum(k) * sum(n - k) FROM c)) AS auc FROM c u, c v)
    SELECT round(max(auc), 6) AS auc, round(avg((p - y) ** 2), 8) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss, round(avg(y), 8) AS event_rate,
    avg(y) < 0.1 OR avg(y) > 0.9 AS rare_events FROM x, a""")
def _(spark, sf):
    _, fit = urgent_fit(spark, sf)
    return rounded(rounded(glm.probability_metrics(glm.scored(fit)), "auc"), "brier", "log_loss", "event_rate", digits=8)


# Deterministic score column for the metric operators.
SCORE = "(l_quantity * 7 + l_discount * 100) % 50 / 50.0"
SCORED = f"WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(({SCORE}) AS DOUBLE) AS p FROM lineitem)"


def scored_rows(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("IF(l_returnflag = 'R', 1.0D, 0.0D) AS y", f"CAST(({SCORE}) AS DOUBLE) AS p")


@query("confusion_matrix", SCORED + """, c AS (SELECT count(CASE WHEN y = 1 AND p >= 0.4 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND p >= 0.4 THEN 1 END) AS fp,
    count(CASE WHEN y = 1 AND p < 0.4 THEN 1 END) AS fn, count(CASE WHEN y = 0 AND p < 0.4 THEN 1 END) AS tn FROM x) SELECT tp, fp, fn, tn,
    round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS accuracy, round(tp * 1.0 / (tp + fn), 6) AS sensitivity, round(tn * 1.0 / (tn + fp), 6) AS specificity,
    round(tp * 1.0 / (tp + fp), 6) AS ppv, round(tn * 1.0 / (tn + fn), 6) AS npv, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(spark, sf):
    return rounded(glm.confusion(scored_rows(spark, sf), 0.4), "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")


@query("roc_points", SCORED + """, c AS (SELECT p, sum(y) AS k, count(*) - sum(y) AS m FROM x GROUP BY 1), r AS (SELECT p AS threshold, sum(k) OVER (ORDER BY p DESC) AS tp,
    sum(m) OVER (ORDER BY p DESC) AS fp, sum(k) OVER () AS ta, sum(m) OVER () AS fa FROM c) SELECT round(threshold, 6) AS threshold, tp, fp,
    round(tp / ta, 6) AS tpr, round(fp / fa, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM r""")
def _(spark, sf):
    return rounded(glm.roc_points(scored_rows(spark, sf)), "threshold", "tpr", "fpr", "precision")


@query("average_precision", SCORED + """, c AS (SELECT p, sum(y) AS k, count(*) AS n FROM x GROUP BY 1), r AS (SELECT k, sum(k) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS pr,
    sum(k) OVER () AS ka FROM c) SELECT round(sum(k * pr / ka), 6) AS average_precision FROM r""")
def _(spark, sf):
    return rounded(glm.average_precision(glm.roc_points(scored_rows(spark, sf))), "average_precision")


@query("calibration_bins", SCORED + """ SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate FROM x GROUP BY 1""")
def _(spark, sf):
    return rounded(glm.calibration_bins(scored_rows(spark, sf)), "mean_predicted", "observed_rate")


@query("hosmer_lemeshow", SCORED + """, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS q FROM x),
    g AS (SELECT len(list_filter(q[2:-2], lambda z: z < p)) AS g, count(*) AS n, sum(y) AS o, sum(p) AS e FROM x, e GROUP BY 1)
    SELECT round(sum((o - e) ** 2 / (e * (1 - e / n))), 4) AS chi2, count(*) AS groups, count(*) - 2 AS df FROM g""")
def _(spark, sf):
    rows = scored_rows(spark, sf)
    return rounded(glm.hosmer_lemeshow(rows).drop("p_value"), "chi2", digits=4)


@query("logistic_train_test")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("urgency", F.expr(URGENT))
    return glm.train_test_logistic(df, "urgency", ["o_orderstatus", "o_totalprice"], "o_orderkey")[2]


# Events per user and type: a saturated count model by event type.
COUNTS = """WITH d AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS y, sum(value) AS total FROM events GROUP BY 1, 2), g AS (SELECT event_type AS s,
    avg(y) AS m, sum(y) AS k, count(*) AS n, sum(total) AS x FROM d GROUP BY 1), r AS (SELECT m AS m1, k AS k1, n AS n1, x AS x1 FROM g ORDER BY s LIMIT 1),
    f AS (SELECT min(s) AS s0 FROM g)"""


def user_counts(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count("*").cast("double").alias("y"), F.sum("value").alias("total"))


@query("poisson_coefficients", COUNTS + """ SELECT CASE WHEN s = s0 THEN 'Intercept' ELSE 'event_type[T.' || s || ']' END AS term,
    round(CASE WHEN s = s0 THEN ln(m) ELSE ln(m / m1) END, 6) AS coefficient, round(sqrt(1 / k + CASE WHEN s = s0 THEN 0 ELSE 1 / k1 END), 6) AS std_error FROM g, r, f""")
def _(spark, sf):
    df = user_counts(spark, sf)
    fit = glm.fit_glm(df, "y", ["event_type"], "poisson")
    return rounded(glm.coefficients(df, fit).select("term", "coefficient", "std_error"), "coefficient", "std_error")


@query("poisson_with_exposure", COUNTS + """ SELECT CASE WHEN s = s0 THEN 'Intercept' ELSE 'event_type[T.' || s || ']' END AS term,
    round(CASE WHEN s = s0 THEN ln(k / x) ELSE ln(k / x / (k1 / x1)) END, 6) AS coefficient FROM g, r, f""")
def _(spark, sf):
    df = user_counts(spark, sf)
    fit = glm.fit_glm(df, "y", ["event_type"], "poisson", exposure="total")
    return rounded(glm.coefficients(df, fit).select("term", "coefficient"), "coefficient")


@query("poisson_fit_statistics", COUNTS + """, x AS (SELECT y, m, (SELECT avg(y) FROM d) AS m0 FROM d JOIN g ON s = event_type) SELECT
    round(sum(y * ln(m) - m - lgamma(y + 1)), 4) AS log_likelihood, round(2 * sum(y * ln(y / m) - (y - m)), 4) AS deviance,
    round(2 * sum(y * ln(y / m0) - (y - m0)), 4) AS null_deviance, round(sum((y - m) ** 2 / m) / (count(*) - 5), 6) AS pearson_chi2_df FROM x""")
def _(spark, sf):
    df = user_counts(spark, sf)
    out = glm.fit_statistics(df, glm.fit_glm(df, "y", ["event_type"], "poisson"))
    out = out.select("log_likelihood", "deviance", "null_deviance", "pearson_chi2_df")
    return rounded(rounded(out, "log_likelihood", "deviance", "null_deviance", digits=4), "pearson_chi2_df")


ZEROS = """WITH d AS (SELECT u.user_id, t.event_type, count(e.event_id) AS y FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN
    (SELECT DISTINCT event_type FROM events) t LEFT JOIN (SELECT * FROM events WHERE value > 60) e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2)"""


@query("count_model_checks", ZEROS + """, g AS (SELECT event_type, avg(y) AS m FROM d GROUP BY 1), s AS (SELECT sum((y - m) ** 2 / m) / (count(*) - 5) AS c,
    count(CASE WHEN y = 0 THEN 1 END) AS z, count(*) * exp(-avg(y)) AS e FROM d JOIN g USING (event_type)) SELECT round(c, 6) AS pearson_chi2_df,
    CASE WHEN c < 1.2 THEN 'none' WHEN c < 1.5 THEN 'mild' WHEN c < 2 THEN 'moderate' ELSE 'strong' END AS overdispersion, z AS observed_zeros,
    round(e, 5) AS expected_zeros, round(z / e, 6) AS zero_ratio, z / e > 1.5 AS excess_zeros FROM s""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    types = [r["event_type"] for r in ev.select("event_type").distinct().orderBy("event_type").collect()]
    wide = ev.groupBy("user_id").agg(*[F.count_if((F.col("event_type") == t) & (F.col("value") > 60)).alias(t) for t in types])
    df = wide.unpivot(["user_id"], types, "event_type", "y")
    return rounded(rounded(glm.count_checks(df, glm.fit_glm(df, "y", ["event_type"], "poisson")), "pearson_chi2_df", "zero_ratio"), "expected_zeros", digits=5)


@query("poisson_train_test")
def _(spark, sf):
    return glm.train_test_poisson(user_counts(spark, sf).withColumn("row", F.concat("user_id", F.lit("-"), "event_type")), "y", ["event_type"], "row")[1]


@query("negative_binomial_coefficients", COUNTS + """ SELECT CASE WHEN s = s0 THEN 'Intercept' ELSE 'event_type[T.' || s || ']' END AS term,
    round(CASE WHEN s = s0 THEN ln(m) ELSE ln(m / m1) END, 6) AS coefficient, round(sqrt((1 + m) / (n * m) + CASE WHEN s = s0 THEN 0 ELSE (1 + m1) / (n1 * m1) END), 6) AS std_error FROM g, r, f""")
def _(spark, sf):
    df = user_counts(spark, sf)
    fit = glm.fit_glm(df, "y", ["event_type"], "negative_binomial")
    return rounded(glm.coefficients(df, fit).select("term", "coefficient", "std_error"), "coefficient", "std_error")


@query("count_model_comparison", COUNTS + """, x AS (SELECT sum(y * ln(m) - m - lgamma(y + 1)) AS lp, sum(y * ln(m / (1 + m)) - ln(1 + m)) AS ln FROM d JOIN g ON s = event_type)
    SELECT 'poisson' AS model, round(-2 * lp + 10, 3) AS aic FROM x UNION ALL SELECT 'negative_binomial', round(-2 * ln + 10, 3) FROM x""")
def _(spark, sf):
    return rounded(glm.compare_count_models(user_counts(spark, sf), "y", ["event_type"]).select("model", "aic"), "aic", digits=3)


@query("predictor_transforms", """WITH c AS (SELECT avg(l_quantity) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - c) ** 2, 4) AS l_quantity_square,
    round(ln(l_extendedprice), 6) AS l_extendedprice_log, round(ln(1 + l_discount), 6) AS l_discount_log1p, round(sqrt(l_tax), 6) AS l_tax_sqrt FROM lineitem, c""")
def _(spark, sf):
    kinds = {"l_quantity": "square", "l_extendedprice": "log", "l_discount": "log1p", "l_tax": "sqrt"}
    out, made = glm.transform_predictors(table(spark, sf, "lineitem"), kinds)
    out = out.select("l_orderkey", "l_linenumber", *made)
    return rounded(rounded(out, "l_extendedprice_log", "l_discount_log1p", "l_tax_sqrt"), "l_quantity_square", digits=4)


@query("linearity_search")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("urgency", F.expr(URGENT))
    return glm.linearity_search(df, "urgency", ["o_totalprice"], "binomial")


def box_tidwell_sql():
    """Both terms standardised, the second freed of the first, which leaves its coefficient as it is but for the scale."""
    rows = f"""SELECT y, 1.0 AS x0, (x - mx) / sx AS x1, (v - mv - b * (x - mx)) / sv AS x2 FROM (SELECT CASE WHEN {URGENT} = 'urgent' THEN 1 ELSE 0 END AS y, o_totalprice AS x, o_totalprice * ln(o_totalprice) AS v FROM orders),
        (SELECT avg(o_totalprice) AS mx, stddev_pop(o_totalprice) AS sx, avg(o_totalprice * ln(o_totalprice)) AS mv, regr_slope(o_totalprice * ln(o_totalprice), o_totalprice) AS b,
            sqrt(var_pop(o_totalprice * ln(o_totalprice)) * (1 - regr_r2(o_totalprice * ln(o_totalprice), o_totalprice))) AS sv FROM orders)"""
    parts = [f"rows AS ({rows})", *logistic_ctes("rows", 3)]
    return f"WITH {', '.join(parts)} SELECT 'o_totalprice' AS predictor, round(abs(x2 / sqrt(v2)), 5) AS size, round({two_sided_sql('x2 / sqrt(v2)')}, 5) AS p_value FROM n8, var"


@query("box_tidwell", box_tidwell_sql())
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("urgency", F.expr(URGENT))
    out = glm.box_tidwell(df, "urgency", ["o_totalprice"], "o_totalprice")
    return rounded(out.select("predictor", F.abs("z").alias("size"), "p_value"), "size", "p_value", digits=5)


@query("ratio_sentences", LOGIT + """, c AS (SELECT 'o_orderstatus[T.' || s || ']' AS term, p / (1 - p) / (p1 / (1 - p1)) AS ratio,
    sqrt(1 / k + 1 / (n - k) + 1 / k1 + 1 / (n1 - k1)) AS se FROM g, r WHERE s <> 'F')
    SELECT term, printf('one unit more of %s goes with %.2f%% %s odds (%s)', term, abs(ratio - 1) * 100, CASE WHEN ratio >= 1 THEN 'higher' ELSE 'lower' END,
    CASE WHEN abs(ln(ratio)) / se > 1.959964 THEN 'significant' ELSE 'not significant' END) AS sentence FROM c""")
def _(spark, sf):
    df, fit = urgent_fit(spark, sf)
    return glm.ratio_sentences(glm.coefficients(df, fit), "odds")


# One column a level would be as many columns as orders; the check demeans by order.
WITHIN = """WITH d AS (SELECT l_orderkey AS g, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b FROM lineitem),
    w AS (SELECT g, y - avg(y) OVER v AS y, a - avg(a) OVER v AS a, b - avg(b) OVER v AS b FROM d WINDOW v AS (PARTITION BY g)),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS "by", sum(y * y) AS yy, count(*) AS n, count(DISTINCT g) AS k FROM w),
    c AS (SELECT *, (ay * bb - "by" * ab) / (aa * bb - ab * ab) AS ca, ("by" * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
    v AS (SELECT *, (yy - ca * ay - cb * "by") / (n - k - 2) AS s2 FROM c)"""


@query("ols_absorbed_levels", WITHIN + """ SELECT 'l_quantity' AS term, round(ca, 5) AS coefficient, round(sqrt(s2 * bb / (aa * bb - ab * ab)), 5) AS std_error, n, k AS levels FROM v
    UNION ALL SELECT 'l_discount', round(cb, 5), round(sqrt(s2 * aa / (aa * bb - ab * ab)), 5), n, k FROM v""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = absorb.absorbed_coefficients(df, absorb.fit_absorbed(df, "l_extendedprice", ["l_quantity", "l_discount"], "l_orderkey"))
    return rounded(out.select("term", "coefficient", "std_error", "n", "levels"), "coefficient", "std_error", digits=5)


@query("ols_level_effects", WITHIN + """ SELECT d.g AS level, count(*) AS n, round(avg(d.y) - any_value(ca) * avg(d.a) - any_value(cb) * avg(d.b), 4) AS effect FROM d, c GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(absorb.fit_absorbed(df, "l_extendedprice", ["l_quantity", "l_discount"], "l_orderkey").effects(), "effect", digits=4)


@query("dummy_coding", """SELECT o_orderkey AS row_id, 'o_custkey' AS "column", dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM orders QUALIFY code > 0
    UNION ALL SELECT o_orderkey, 'o_orderstatus', dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS code FROM orders QUALIFY code > 0""")
def _(spark, sf):
    return absorb.sparse_coding(table(spark, sf, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"])
