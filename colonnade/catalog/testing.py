"""Correlation and hypothesis-test queries. SQL checks the statistics; p-values are checked in the unit tests."""

from pyspark.sql import functions as F

from colonnade.catalog.base import DIRTY_SQL, TAILED_SQL, dirty_lineitem, erf_sql, poly_sql, quantile_sql, query, table, tailed_orders
from colonnade.catalog.profiling import rounded, union_sql
from colonnade.operators import hypothesis as h

NUM = ["quantity", "price", "discount", "tax"]
PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
PEARSON = f"WITH d AS ({DIRTY_SQL}), m AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {'1.0' if a == b else f'corr({a}, {b})'} AS r, {i} AS i, {j} AS j FROM d "
    + ("WHERE 1 = 1 LIMIT 1" if a == b else "")
    for i, a in enumerate(NUM) for j, b in enumerate(NUM) if a != b) + ")"


@query("correlation_matrix_pearson", PEARSON + " SELECT x, y, round(r, 6) AS r FROM m UNION ALL SELECT v, v, 1.0 FROM (VALUES "
       + ", ".join(f"('{c}')" for c in NUM) + ") t(v)")
def _(spark, sf):
    return rounded(h.correlation_matrix(dirty_lineitem(spark, sf), NUM), "r").select("x", "y", "r")


@query("correlation_strong_pairs", """WITH d AS (SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net
    FROM lineitem), m AS (""" + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM d"
        for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "net"])
        for b in ["l_quantity", "l_extendedprice", "l_discount", "net"][i + 1:])
       + ") SELECT x, y, r, abs(r) AS abs_r FROM m WHERE abs(r) >= 0.5")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * (1 - l_discount) AS net")
    return rounded(h.strong_pairs(h.correlation_matrix(df), 0.5), "r", "abs_r")


def rank_sql(source, x, y):
    return f"""WITH d AS (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)"""


@query("correlation_spearman", rank_sql("lineitem", "l_quantity", "l_extendedprice")
       + " SELECT count(*) AS n, round(corr(rx, ry), 6) AS r FROM r")
def _(spark, sf):
    return rounded(h.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "r")


@query("correlation_matrix_spearman", rank_sql("orders", "o_totalprice", "o_custkey")
       + " SELECT 'o_totalprice' AS x, 'o_custkey' AS y, round(corr(rx, ry), 6) AS r FROM r")
def _(spark, sf):
    m = h.correlation_matrix(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "spearman")
    return rounded(m.where("i < j").select("x", "y", "r"), "r")


@query("correlation_kendall", """WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS c FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s FROM c a, c b),
    t AS (SELECT sum(c) AS n FROM c), tx AS (SELECT sum(t * (t - 1)) / 2.0 AS v FROM (SELECT sum(c) AS t FROM c GROUP BY x)),
    ty AS (SELECT sum(t * (t - 1)) / 2.0 AS v FROM (SELECT sum(c) AS t FROM c GROUP BY y))
    SELECT CAST(n AS BIGINT) AS n, round(s / (sqrt(n * (n - 1) / 2.0 - tx.v) * sqrt(n * (n - 1) / 2.0 - ty.v)), 8) AS r FROM s, t, tx, ty""")
def _(spark, sf):
    return rounded(h.kendall(table(spark, sf, "lineitem"), "l_quantity", "l_discount").select("n", "r"), "r", digits=8)


@query("correlation_kendall_continuous", """WITH c AS (SELECT c_acctbal AS x, c_custkey AS y FROM customer),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s FROM c a, c b), t AS (SELECT count(*) AS n FROM c),
    tx AS (SELECT sum(t * (t - 1)) / 2.0 AS v FROM (SELECT count(*) AS t FROM c GROUP BY x))
    SELECT n, round(s / (sqrt(n * (n - 1) / 2.0 - tx.v) * sqrt(n * (n - 1) / 2.0)), 8) AS r FROM s, t, tx""")
def _(spark, sf):
    return rounded(h.kendall(table(spark, sf, "customer"), "c_acctbal", "c_custkey").select("n", "r"), "r", digits=8)


@query("correlation_test_kendall", """WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS c FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s FROM c a, c b), t AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM c),
    tx AS (SELECT sum(t * (t - 1)) AS v, sum(t * (t - 1) * (t - 2)) AS z, sum(t * (t - 1) * (2 * t + 5)) AS u FROM (SELECT CAST(sum(c) AS DOUBLE) AS t FROM c GROUP BY x)),
    ty AS (SELECT sum(t * (t - 1)) AS v, sum(t * (t - 1) * (t - 2)) AS z, sum(t * (t - 1) * (2 * t + 5)) AS u FROM (SELECT CAST(sum(c) AS DOUBLE) AS t FROM c GROUP BY y)),
    z AS (SELECT n, s / (sqrt((n * (n - 1) - tx.v) / 2) * sqrt((n * (n - 1) - ty.v) / 2)) AS r,
          abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - tx.u - ty.u) / 18 + tx.v * ty.v / (2 * n * (n - 1)) + tx.z * ty.z / (9 * n * (n - 1) * (n - 2))) / sqrt(2) AS h FROM s, t, tx, ty)
    SELECT 'kendall' AS method, CAST(n AS BIGINT) AS n, round(r, 8) AS r,
           round(1 - 2 / sqrt(pi()) * (SELECT sum((-1) ** k * h ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) FROM range(0, 80) g(k)), 7) AS p_value FROM z""")
def _(spark, sf):
    out = h.correlation_test(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "kendall")
    return rounded(rounded(out.select("method", "n", "r", "p_value"), "r", digits=8), "p_value", digits=7)


@query("correlation_test_pearson", """SELECT 'pearson' AS method, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r,
    round(tanh(atanh(corr(l_quantity, l_extendedprice)) - 1.959963984540054 / sqrt(count(*) - 3)), 6) AS ci_low,
    round(tanh(atanh(corr(l_quantity, l_extendedprice)) + 1.959963984540054 / sqrt(count(*) - 3)), 6) AS ci_high FROM lineitem""")
def _(spark, sf):
    out = h.correlation_test(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out, "r", "ci_low", "ci_high").select("method", "n", "r", "ci_low", "ci_high")


@query("p_value_and_effect_labels", """SELECT l_discount AS p, CASE WHEN l_discount < 0.001 THEN 'p < 0.001' WHEN l_discount < 0.01
    THEN 'p < 0.01' WHEN l_discount < 0.05 THEN 'p < 0.05' WHEN l_discount < 0.1 THEN 'p < 0.10' ELSE 'p >= 0.10' END AS label,
    CASE WHEN l_discount * 10 < 0.2 THEN 'negligible' WHEN l_discount * 10 < 0.5 THEN 'small' WHEN l_discount * 10 < 0.8
    THEN 'medium' ELSE 'large' END AS effect, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.col("l_discount").alias("p")).agg(F.count("*").alias("n"))
    return df.select("p", h.p_value_label_column(F.col("p")).alias("label"),
                     h.effect_label_column(F.col("p") * 10).alias("effect"), "n")


def shapiro_sql(rows):
    """W for more than five values: ``rows`` is a query with the column x."""
    return f"""WITH x AS ({rows}), o AS (SELECT x - avg(x) OVER () AS x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM x),
    p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o), m AS (SELECT x, i, n, {quantile_sql("p")} AS m FROM p),
    s AS (SELECT sum(m * m) AS ss, max(n) AS n, 1 / sqrt(max(n)) AS u, max(CASE WHEN i = n THEN m END) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2 FROM m),
    a AS (SELECT *, m1 / sqrt(ss) + {poly_sql(h.ROYSTON_A1, "u")} AS a1, m2 / sqrt(ss) + {poly_sql(h.ROYSTON_A2, "u")} AS a2 FROM s),
    w AS (SELECT *, sqrt((ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS k FROM a)
    SELECT CAST(max(w.n) AS BIGINT) AS n, round(sum(x * CASE WHEN i = w.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = w.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / k END) ** 2 / sum(x * x), 6) AS statistic FROM m, w"""


SHAPIRO_GROUPS = f"""WITH o AS (SELECT o_custkey AS g, CAST(o_totalprice AS DOUBLE) - avg(o_totalprice) OVER w AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)),
    p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o WHERE n > 5), m AS (SELECT g, x, i, n, {quantile_sql("p")} AS m FROM p),
    s AS (SELECT g, sum(m * m) AS ss, max(n) AS k, 1 / sqrt(max(n)) AS u, max(CASE WHEN i = n THEN m END) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2 FROM m GROUP BY 1),
    a AS (SELECT *, m1 / sqrt(ss) + {poly_sql(h.ROYSTON_A1, "u")} AS a1, m2 / sqrt(ss) + {poly_sql(h.ROYSTON_A2, "u")} AS a2 FROM s),
    w AS (SELECT *, sqrt((ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS f FROM a)
    SELECT CAST(g AS VARCHAR) AS "group", max(n) AS n, round(sum(x * CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / f END) ** 2 / sum(x * x), 7) AS statistic FROM m JOIN w USING (g) GROUP BY 1"""


@query("normality_shapiro_by_group", SHAPIRO_GROUPS)
def _(spark, sf):
    out = h.shapiro_by_group(table(spark, sf, "orders"), "o_custkey", "o_totalprice").where("n > 5")
    return rounded(out.select("group", "n", "statistic"), "statistic", digits=7)


@query("normality_shapiro_wilk", shapiro_sql("SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem"))
def _(spark, sf):
    return rounded(h.shapiro_wilk(table(spark, sf, "lineitem"), "l_extendedprice").select("n", "statistic"), "statistic")


@query("correlation_test_spearman", """WITH r AS (SELECT avg(i) OVER (PARTITION BY x) AS rx, avg(j) OVER (PARTITION BY y) AS ry FROM (SELECT l_quantity AS x, l_discount AS y,
    row_number() OVER (ORDER BY l_quantity) AS i, row_number() OVER (ORDER BY l_discount) AS j FROM lineitem)) SELECT 'spearman' AS method, count(*) AS n, round(corr(rx, ry), 6) AS r FROM r""")
def _(spark, sf):
    return rounded(h.correlation_test(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "spearman").select("method", "n", "r"), "r")


@query("normality_kolmogorov_smirnov", f"""WITH c AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v, count(*) AS c FROM lineitem GROUP BY 1), m AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, count(*) AS n FROM lineitem),
    z AS (SELECT (v - m) / s AS z, sum(c) OVER (ORDER BY v) AS upto, c, n FROM c, m), f AS (SELECT *, 0.5 + 0.5 * sign(z) * {erf_sql("(abs(z) / sqrt(2))")} AS f FROM z)
    SELECT 'kolmogorov_smirnov' AS test, any_value(n) AS n, round(max(greatest(upto / n - f, f - (upto - c) / n)), 8) AS statistic FROM f""")
def _(spark, sf):
    out = h.kolmogorov_smirnov(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(out.select("test", "n", "statistic"), "statistic", digits=8)


DAGOSTINO = """WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, skewness_pop AS g1, kurt_pop + 3 AS b2 FROM (SELECT
    avg((x - mu) ** 3) / avg((x - mu) ** 2) ** 1.5 AS skewness_pop, avg((x - mu) ** 4) / avg((x - mu) ** 2) ** 2 - 3 AS kurt_pop,
    count(*) AS n FROM (SELECT {c} AS x, avg({c}) OVER () AS mu FROM {t})), {t} GROUP BY 2, 3),
    s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
      / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5)
      / (n * (n - 2) * (n - 3))) AS root, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x FROM m),
    w AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / root ** 2)) AS a FROM s),
    z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4)))
      * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM w)
    SELECT CAST(n AS BIGINT) AS n, round(z1, 5) AS z_skew, round(z2, 5) AS z_kurtosis, round(z1 * z1 + z2 * z2, 4) AS statistic,
    round(exp(-(z1 * z1 + z2 * z2) / 2), 8) AS p_value FROM z"""


@query("normality_dagostino_pearson", DAGOSTINO.format(c="c_acctbal", t="customer"))
def _(spark, sf):
    out = h.dagostino_pearson(table(spark, sf, "customer"), "c_acctbal").drop("test")
    return rounded(rounded(rounded(out, "z_skew", "z_kurtosis", digits=5), "statistic", digits=4), "p_value", digits=8)


@query("t_test_one_sample", """SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
    round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 5) AS t, CAST(count(*) - 1 AS DOUBLE) AS df,
    round((avg(l_quantity) - 25) / stddev_samp(l_quantity), 6) AS cohens_d FROM lineitem""")
def _(spark, sf):
    out = h.one_sample_t(table(spark, sf, "lineitem"), "l_quantity", 25)
    return rounded(rounded(out, "mean", "std", "cohens_d"), "t", digits=5).drop("p_value", "ci_low", "ci_high")


TWO = f"""WITH d AS ({DIRTY_SQL}), a AS (SELECT count(price) AS n, avg(price) AS m, var_samp(price) AS v FROM d WHERE linestatus = 'F'),
    b AS (SELECT count(price) AS n, avg(price) AS m, var_samp(price) AS v FROM d WHERE linestatus = 'O')"""


@query("t_test_welch", TWO + """ SELECT 'F' AS group_a, 'O' AS group_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t,
    round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 2) AS df,
    round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS cohens_d, 'negligible' AS effect FROM a, b""")
def _(spark, sf):
    out = h.independent_t(dirty_lineitem(spark, sf), "linestatus", "price").drop("p_value")
    return rounded(rounded(rounded(out, "t", digits=5), "cohens_d"), "df", digits=2)


@query("t_test_pooled", TWO + """ SELECT 'F' AS group_a, 'O' AS group_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v)
    / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 5) AS t, CAST(a.n + b.n - 2 AS DOUBLE) AS df FROM a, b""")
def _(spark, sf):
    out = h.independent_t(dirty_lineitem(spark, sf), "linestatus", "price", equal_variances=True)
    return rounded(out, "t", digits=5).select("group_a", "group_b", "t", "df")


@query("group_statistics", f"""WITH d AS ({DIRTY_SQL}) SELECT returnflag AS "group", count(*) AS n, round(avg(price), 4) AS mean,
    round(stddev_samp(price), 4) AS std, round(var_samp(price), 1) AS variance, round(median(price), 4) AS median FROM d
    WHERE returnflag IS NOT NULL AND price IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    out = h.group_statistics(dirty_lineitem(spark, sf), "returnflag", "price")
    return rounded(rounded(out, "mean", "std", "median", digits=4), "variance", digits=1)


@query("t_test_paired", """WITH d AS (SELECT l_discount - l_tax AS x FROM lineitem) SELECT count(*) AS n, round(avg(x), 8) AS mean,
    round(stddev_samp(x), 8) AS std, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t, CAST(count(*) - 1 AS DOUBLE) AS df,
    round(avg(x) / stddev_samp(x), 6) AS cohens_d FROM d""")
def _(spark, sf):
    out = h.paired_t(table(spark, sf, "lineitem"), "l_discount", "l_tax").drop("p_value", "ci_low", "ci_high")
    return rounded(rounded(rounded(out, "mean", "std", digits=8), "t", digits=4), "cohens_d")


@query("mann_whitney", """WITH d AS (SELECT l_linestatus AS g, l_quantity AS v FROM lineitem), r AS (SELECT g, v,
    rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM d), s AS (SELECT
    CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN g = 'F' THEN 1 END) AS DOUBLE) AS n1, sum(CASE WHEN g = 'F' THEN r END) AS r1 FROM r),
    t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY v)),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n - n1 AS n2 FROM s, t)
    SELECT 'F' AS group_a, 'O' AS group_b, u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1)
    - ties / (n * (n - 1)))), 6) AS z FROM u""")
def _(spark, sf):
    return rounded(h.mann_whitney(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity").drop("p_value"), "z")


@query("kruskal_wallis", """WITH d AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem), r AS (SELECT g,
    rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM d), t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties,
    CAST(sum(c) AS DOUBLE) AS n FROM (SELECT count(*) AS c FROM d GROUP BY v)), s AS (SELECT sum(r2) AS q FROM (SELECT sum(r) ** 2 / count(*) AS r2
    FROM r GROUP BY g)) SELECT 3 AS groups, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) AS h,
    2 AS df, round(exp(-(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) / 2), 5) AS p_value FROM s, t""")
def _(spark, sf):
    out = h.kruskal_wallis(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(rounded(out, "h", digits=4), "p_value", digits=5)


ANOVA = """g AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_samp(v) AS s2 FROM d GROUP BY 1),
    t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mu, sum((n - 1) * s2) AS w FROM g),
    b AS (SELECT sum(g.n * (m - mu) ** 2) AS b FROM g, t)"""


@query("anova", "WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders), " + ANOVA + """
    SELECT k AS groups, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / (w / (n - k)), 6) AS f, k - 1 AS df_between,
    CAST(n - k AS BIGINT) AS df_within, round(b / (b + w), 8) AS eta_squared FROM t, b""")
def _(spark, sf):
    out = h.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").drop("p_value")
    return rounded(rounded(out, "f"), "eta_squared", digits=8)


@query("tukey_hsd", "WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders), " + ANOVA + """
    SELECT x.g AS group_a, y.g AS group_b, round(y.m - x.m, 3) AS mean_difference,
    round(abs(y.m - x.m) / sqrt(w / (t.n - k) / 2 * (1 / x.n + 1 / y.n)), 5) AS q FROM g x, g y, t WHERE x.g < y.g""")
def _(spark, sf):
    out = h.tukey_hsd(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(rounded(out, "mean_difference", digits=3), "q", digits=5).select("group_a", "group_b", "mean_difference", "q")


@query("levene", """WITH e AS (SELECT o_orderpriority AS g, median(o_totalprice) AS md FROM orders GROUP BY 1),
    d AS (SELECT o_orderpriority AS g, abs(o_totalprice - md) AS v FROM orders JOIN e ON g = o_orderpriority), """ + ANOVA + """
    SELECT k AS groups, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / (w / (n - k)), 5) AS w, k - 1 AS df_between,
    CAST(n - k AS BIGINT) AS df_within FROM t, b""")
def _(spark, sf):
    return rounded(h.levene(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").drop("p_value"), "w", digits=5)


CHI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY 1, 2), e AS (SELECT a, b, o,
    sum(o) OVER (PARTITION BY a) * 1.0 * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c)"""


@query("chi_square_cells", CHI.format(a="o_orderpriority", b="o_orderstatus", t="orders")
       + " SELECT a, b, o AS observed, round(e, 4) AS expected FROM e")
def _(spark, sf):
    return rounded(h.chi_square_cells(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"), "expected", digits=4)


@query("chi_square", CHI.format(a="o_orderpriority", b="o_orderstatus", t="orders") + """ SELECT round(sum((o - e) ** 2 / e), 5) AS chi2,
    8 AS df, CAST(max(n) AS BIGINT) AS n, round(sqrt(sum((o - e) ** 2 / e) / (max(n) * 2)), 6) AS cramers_v,
    CAST(count(CASE WHEN e < 5 THEN 1 END) * 100.0 / count(*) AS DOUBLE) AS low_expected_percent FROM e""")
def _(spark, sf):
    out = h.chi_square(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").drop("p_value")
    return rounded(rounded(out, "chi2", digits=5), "cramers_v")


@query("chi_square_yates", CHI.format(a="l_linestatus", b="(l_quantity > 25)", t="lineitem") + """ SELECT
    round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 6) AS chi2, 1 AS df, CAST(max(n) AS BIGINT) AS n FROM e""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("big", F.col("l_quantity") > 25)
    return rounded(h.chi_square(df, "l_linestatus", "big").select("chi2", "df", "n"), "chi2")


@query("fisher_exact", """WITH c AS (SELECT count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) * 1.0 AS a,
    count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS b, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS c,
    count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS d FROM labels), s AS (SELECT a, b, c, d, CAST(unnest(range(
    CAST(greatest(0, a + c - (c + d)) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1)) AS DOUBLE) AS i FROM c),
    p AS (SELECT i, a, b, c, d, lgamma(a+b+1) - lgamma(i+1) - lgamma(a+b-i+1) + lgamma(c+d+1) - lgamma(a+c-i+1) - lgamma(c+d-(a+c)+i+1)
    - (lgamma(a+b+c+d+1) - lgamma(a+c+1) - lgamma(b+d+1)) AS lp FROM s), o AS (SELECT lp AS own FROM p WHERE i = a)
    SELECT round(max(a * d / (b * c)), 6) AS odds_ratio, round(least(1, sum(exp(lp))), 6) AS p_value,
    CAST(max(a + b + c + d) AS BIGINT) AS n FROM p, o WHERE lp <= own + 1e-7""")
def _(spark, sf):
    return rounded(h.fisher_exact(table(spark, sf, "labels"), "quality", "toxic"), "odds_ratio", "p_value")
