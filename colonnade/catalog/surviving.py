"""Survival queries on lineitem: quantity (heavily tied) or price (continuous) as time, a return as the event."""

import math

from pyspark.sql import functions as F

from colonnade.catalog.base import query, solve_ctes, table
from colonnade.catalog.profiling import rounded
from colonnade.operators import survival as s

ROWS = "SELECT l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, l_linestatus AS g, l_returnflag, l_discount FROM lineitem"
FINE = ROWS.replace("l_quantity AS t", "l_extendedprice AS t")
LIFE = "WITH x AS ({rows}), c AS (SELECT g, t, sum(e) AS d, count(*) AS c FROM x GROUP BY 1, 2), r AS (SELECT g, t, d, c, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM c)"


def tied(spark, sf):
    df = table(spark, sf, "lineitem")
    out = s.survival_frame(df, "l_quantity", s.event_indicator(df, "l_returnflag", "R"), ["l_linestatus", "l_returnflag", "l_discount", "l_tax"])
    return out.withColumnRenamed("l_linestatus", "g")


def fine(spark, sf):
    df = table(spark, sf, "lineitem")
    out = s.survival_frame(df, "l_extendedprice", s.event_indicator(df, "l_returnflag", "R"), ["l_linestatus", "l_returnflag", "l_discount", "l_tax"])
    return out.withColumnRenamed("l_linestatus", "g")


@query("survival_event_coding", "SELECT l_returnflag AS value, count(*) AS count, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event FROM lineitem GROUP BY 1")
def _(spark, sf):
    return s.event_coding(table(spark, sf, "lineitem"), "l_returnflag", "R")


@query("survival_frame", """SELECT value - 20 AS t, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS e, event_id FROM events WHERE value - 20 >= 0""")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("shifted", F.col("value") - 20)
    return s.survival_frame(df, "shifted", s.event_indicator(df, "event_type", "purchase"), ["event_id"])


KM = """, k AS (SELECT *, CASE WHEN d = n THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d * 1.0 / n) ELSE 0 END) OVER w) END AS s,
    sum(CASE WHEN d < n THEN d * 1.0 / (n * (n - d)) ELSE 0 END) OVER w AS v FROM r WINDOW w AS (PARTITION BY g ORDER BY t))"""
KM_OUT = """ SELECT g, t, CAST(d AS BIGINT) AS events, c AS observed, CAST(n AS BIGINT) AS at_risk, round(s, 8) AS survival,
    round(CASE WHEN s = 1 THEN 1 WHEN s > 0 THEN exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(v) / ln(s))) END, 8) AS ci_low,
    round(CASE WHEN s = 1 THEN 1 WHEN s > 0 THEN exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(v) / ln(s))) END, 8) AS ci_high FROM k"""


@query("kaplan_meier_by_group", LIFE.format(rows=ROWS) + KM + KM_OUT)
def _(spark, sf):
    return rounded(s.kaplan_meier(tied(spark, sf), ["g"]), "survival", "ci_low", "ci_high", digits=8)


@query("kaplan_meier_overall", LIFE.format(rows=FINE.replace("l_linestatus AS g", "'all' AS g")) + KM + KM_OUT.replace("SELECT g, t", "SELECT t"))
def _(spark, sf):
    return rounded(s.kaplan_meier(fine(spark, sf)), "survival", "ci_low", "ci_high", digits=8)


@query("median_survival", LIFE.format(rows=FINE) + KM + " SELECT g, min(CASE WHEN s <= 0.5 THEN t END) AS median_survival FROM k GROUP BY 1")
def _(spark, sf):
    return s.median_survival(s.kaplan_meier(fine(spark, sf), ["g"]), ["g"])


@query("survival_at_quantiles", LIFE.format(rows=ROWS) + KM + """, q AS (SELECT unnest(quantile_cont(t, [0.2, 0.4, 0.6, 0.8])) AS time FROM x)
    SELECT g, time, round(arg_max(s, t), 8) AS survival FROM k, q WHERE t <= time GROUP BY 1, 2""")
def _(spark, sf):
    rows = tied(spark, sf)
    return rounded(s.survival_at(s.kaplan_meier(rows, ["g"]), s.quantile_times(rows), ["g"]), "survival", digits=8)


@query("risk_table", f"""WITH x AS ({ROWS}), q AS (SELECT DISTINCT unnest(quantile_cont(t, [0, 0.2, 0.4, 0.6, 0.8])) AS time FROM x)
    SELECT g, time, count(CASE WHEN t >= time THEN 1 END) AS at_risk FROM x, q GROUP BY 1, 2""")
def _(spark, sf):
    rows = tied(spark, sf)
    return s.risk_table(rows, s.quantile_times(rows, (0.0, 0.2, 0.4, 0.6, 0.8)), ["g"])


LOGRANK = """, w AS (SELECT t, sum(CASE WHEN g = 'F' THEN c ELSE 0 END) AS c0, sum(c) AS ca, sum(CASE WHEN g = 'F' THEN d ELSE 0 END) AS d0, sum(d) AS da FROM c GROUP BY 1),
    z AS (SELECT *, sum(c0) OVER (ORDER BY t DESC) AS n0, CAST(sum(ca) OVER (ORDER BY t DESC) AS DOUBLE) AS na FROM w)
    SELECT 2 AS groups, round(sum(d0 - da * n0 / na) ** 2 / sum(da * (na - da) / greatest(na - 1, 1) * n0 / na * (1 - n0 / na)), 6) AS chi2, 1 AS df FROM z WHERE da > 0"""


@query("log_rank", LIFE.format(rows=ROWS) + LOGRANK)
def _(spark, sf):
    return rounded(s.log_rank(tied(spark, sf), "g").drop("p_value"), "chi2")


def log_rank_sql(k: int) -> str:
    """Log-rank test of bands 0 to k - 1 (an odd number, so the tail is a finite sum), its quadratic form by elimination."""
    at = [f"sum(count(*) FILTER (band = {i})) OVER (ORDER BY t DESC)::DOUBLE AS r{i}, sum(e) FILTER (band = {i}) AS d{i}" for i in range(k)]
    spread = "da * (na - da) / greatest(na - 1, 1)"
    sums = [f"sum(coalesce(d{i}, 0) - da * r{i} / na) AS b{i}" for i in range(k - 1)]
    sums += [f"sum({spread} * r{i} / na * ({int(i == j)} - r{j} / na)) AS a{i}_{j}" for i in range(k - 1) for j in range(k - 1)]
    half = (k - 1) // 2
    ctes = [
        "x AS (SELECT l_extendedprice AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, floor(l_tax * 50) AS band FROM lineitem)",
        f"c AS (SELECT t, {', '.join(at)}, sum(e) AS da, sum(count(*)) OVER (ORDER BY t DESC)::DOUBLE AS na FROM x GROUP BY t)",
        f"q AS (SELECT {', '.join(sums)} FROM c WHERE da > 0)",
        *solve_ctes("w", "q", k - 1),
        f"z AS (SELECT {' + '.join(f'q.b{i} * w.x{i}' for i in range(k - 1))} AS chi2 FROM q, w)",
    ]
    tail = " + ".join(f"(chi2 / 2) ** {j} / {math.factorial(j)}" for j in range(half))
    return f"WITH {', '.join(ctes)} SELECT {k} AS groups, round(chi2, 6) AS chi2, {k - 1} AS df, round(exp(-chi2 / 2) * ({tail}), 6) AS p_value FROM z"


@query("log_rank_many_groups", log_rank_sql(5))
def _(spark, sf):
    rows = fine(spark, sf).withColumn("band", F.floor(F.col("l_tax") * 50))
    return rounded(s.log_rank(rows, "band"), "chi2", "p_value")


@query("nelson_aalen", LIFE.format(rows=ROWS) + """, h AS (SELECT *, sum(list_sum(list_transform(range(CAST(d AS BIGINT)), lambda j: 1.0 / (n - j)))) OVER w AS h,
    sum(list_sum(list_transform(range(CAST(d AS BIGINT)), lambda j: 1.0 / ((n - j) * (n - j))))) OVER w AS v FROM r WINDOW w AS (PARTITION BY g ORDER BY t))
    SELECT g, t, CAST(d AS BIGINT) AS events, CAST(n AS BIGINT) AS at_risk, round(h, 7) AS cumulative_hazard, round(h / exp(1.959963984540054 * sqrt(v) / h), 7) AS ci_low,
    round(h * exp(1.959963984540054 * sqrt(v) / h), 7) AS ci_high FROM h""")
def _(spark, sf):
    return rounded(s.nelson_aalen(tied(spark, sf), ["g"]), "cumulative_hazard", "ci_low", "ci_high", digits=7)


@query("survival_event_checks", f"""WITH x AS ({ROWS}) SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS events, round(sum(e) * 100.0 / count(*), 6) AS event_percent,
    CASE WHEN sum(e) * 100.0 / count(*) < 10 THEN 'low' WHEN sum(e) * 100.0 / count(*) < 30 THEN 'moderate' ELSE 'good' END AS rate_band,
    sum(e) / 3.0 AS events_per_coefficient, sum(e) / 3.0 < 10 AS too_few_events FROM x""")
def _(spark, sf):
    return rounded(rounded(s.event_checks(tied(spark, sf), 3), "event_percent"), "events_per_coefficient")


@query("survival_tied_events", f"""WITH x AS ({FINE}), c AS (SELECT t, count(*) AS d FROM x WHERE e = 1 GROUP BY 1) SELECT count(*) AS event_times,
    count(CASE WHEN d > 1 THEN 1 END) AS tied_times, CAST(coalesce(sum(CASE WHEN d > 1 THEN d END), 0) AS BIGINT) AS tied_events, max(d) AS largest_tie FROM c""")
def _(spark, sf):
    return s.tied_events(fine(spark, sf))


def newton_cox(rows, steps=7):
    """SQL of ``rows`` (t, e, x, s): Newton steps of Efron's partial likelihood with one predictor and strata, unrolled."""
    out = f"c AS (SELECT s, t, x, count(*) AS n, sum(e) AS ev FROM ({rows}) GROUP BY ALL), b0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS h)"
    for k in range(steps):
        out += f""",
    w{k} AS (SELECT s, t, sum(n * exp(b * x)) AS q0, sum(n * exp(b * x) * x) AS q1, sum(n * exp(b * x) * x * x) AS q2, sum(ev) AS d, sum(ev * x) AS z,
        sum(ev * exp(b * x)) AS d0, sum(ev * exp(b * x) * x) AS d1, sum(ev * exp(b * x) * x * x) AS d2 FROM c, b{k} GROUP BY 1, 2),
    r{k} AS (SELECT *, sum(q0) OVER o AS r0, sum(q1) OVER o AS r1, sum(q2) OVER o AS r2 FROM w{k} WINDOW o AS (PARTITION BY s ORDER BY t DESC)),
    l{k} AS (SELECT *, l / d AS f FROM (SELECT *, unnest(range(d::BIGINT)) AS l FROM r{k} WHERE d > 0)),
    m{k} AS (SELECT (r1 - f * d1) / (r0 - f * d0) AS m, (r2 - f * d2) / (r0 - f * d0) AS v FROM l{k}),
    b{k + 1} AS (SELECT b + (zs - ms) / hs AS b, hs AS h FROM b{k}, (SELECT sum(z) AS zs FROM r{k}), (SELECT sum(m) AS ms, sum(v - m * m) AS hs FROM m{k}))"""
    return f"WITH {out} SELECT round(b, 7) AS coefficient, round(1 / sqrt(h), 7) AS std_error FROM b{steps}"


@query("cox_one_predictor", newton_cox("SELECT l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, l_discount AS x, 0 AS s FROM lineitem"))
def _(spark, sf):
    rows = tied(spark, sf)
    return rounded(s.cox_coefficients(rows, s.cox(rows, ["l_discount"])).select("coefficient", "std_error"), "coefficient", "std_error", digits=7)


@query("cox_one_predictor_strata", newton_cox("SELECT l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, l_tax AS x, l_suppkey % 7 AS s FROM lineitem"))
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"), "l_tax", (F.col("l_suppkey") % 7).alias("st"))
    return rounded(s.cox_coefficients(rows, s.cox(rows, ["l_tax"], strata="st")).select("coefficient", "std_error"), "coefficient", "std_error", digits=7)


@query("cox_coefficients")
def _(spark, sf):
    rows = tied(spark, sf)
    return s.cox_coefficients(rows, s.cox(rows, ["g", "l_discount"]))


@query("cox_stratified")
def _(spark, sf):
    rows = fine(spark, sf)
    return s.cox_coefficients(rows, s.cox(rows, ["l_discount"], strata="g"))


@query("cox_statistics")
def _(spark, sf):
    rows = fine(spark, sf)
    return s.cox_statistics(rows, s.cox(rows, ["l_discount", "l_tax"]))


@query("concordance", """WITH x AS (SELECT l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, round(l_discount * 100) AS score FROM lineitem),
    c AS (SELECT t, e, score, count(*) AS c FROM x GROUP BY 1, 2, 3), p AS (SELECT a.c * b.c AS w, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END AS k
    FROM c a JOIN c b ON a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0))) SELECT CAST(sum(w) AS DOUBLE) AS pairs, round(sum(w * k) / sum(w), 8) AS concordance FROM p""")
def _(spark, sf):
    rows = tied(spark, sf).select("t", "e", F.round(F.col("l_discount") * 100).alias("score"))
    return rounded(s.concordance(rows), "concordance", digits=8)


@query("proportional_hazards_test")
def _(spark, sf):
    rows = tied(spark, sf)
    return s.ph_test(rows, s.cox(rows, ["g", "l_discount"]))


@query("martingale_residuals")
def _(spark, sf):
    rows = tied(spark, sf)
    return s.martingale_residuals(s.cox(rows, ["l_discount"]))


@query("log_log_curves", LIFE.format(rows=ROWS) + KM + " SELECT g, t, round(ln(t), 8) AS log_time, round(ln(-ln(s)), 7) AS log_minus_log FROM k WHERE s > 0 AND s < 1 AND t > 0")
def _(spark, sf):
    return rounded(rounded(s.log_log_curves(tied(spark, sf), "g"), "log_time", digits=8), "log_minus_log", digits=7)


@query("aft_weibull")
def _(spark, sf):
    rows = fine(spark, sf)
    return s.aft_coefficients(rows, s.fit_aft(rows, ["g", "l_discount"]))


@query("aft_comparison")
def _(spark, sf):
    return s.compare_aft(fine(spark, sf), ["l_discount"])


@query("aft_curves")
def _(spark, sf):
    rows = fine(spark, sf)
    fit = s.fit_aft(rows, ["l_discount"], "log_logistic")
    return s.aft_curves(rows, fit, rows.select("l_discount").distinct().orderBy("l_discount").limit(3))
