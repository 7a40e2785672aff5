"""Causal-inference and mixed-model queries: urgent orders as treatment, order total as outcome."""

import math

from pyspark.sql import functions as F

from colonnade.catalog.base import erf_sql, query, table
from colonnade.catalog.profiling import rounded
from colonnade.operators import causal as c
from colonnade.operators import matching as m
from colonnade.operators import mixed

# A score that is a plain function of the row, unique per order, so that SQL can follow the matching exactly.
SCORE = "((o_orderkey * 7919) % 1000003) / 1.000003e6"
TREATED = "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END"
BIG = "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END"
BASE = f"""WITH d AS (SELECT o_orderkey AS id, {TREATED} AS treated, CAST({SCORE} AS DOUBLE) AS ps, o_totalprice AS y, {BIG} AS big, o_orderstatus, c_mktsegment, c_acctbal, c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def study(spark, sf):
    df = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.selectExpr("o_orderkey AS id", f"{TREATED} AS treated", f"CAST({SCORE} AS DOUBLE) AS ps", "o_totalprice AS y", f"{BIG} AS big",
                         "o_orderstatus", "c_mktsegment", "c_acctbal", "c_nationkey")


def units(spark, sf, keys=()):
    return m.units_of(study(spark, sf), "id", "treated", "ps", keys)


@query("causal_readiness", BASE + """, q AS (SELECT count(*) AS n, sum(treated) AS t, count(DISTINCT y) AS k FROM d)
    SELECT 'treatment is 0/1' AS "check", t > 0 AND t < n AS passed, t || ' treated, ' || (n - t) || ' control' AS detail FROM q UNION ALL SELECT 'enough rows', n >= 20, n || ' rows' FROM q
    UNION ALL SELECT 'outcome type', k > 1, CASE WHEN k = 2 THEN 'binary' ELSE 'continuous' END FROM q""")
def _(spark, sf):
    return c.readiness(study(spark, sf), "treated", "y")


COVARIATES = ["c_acctbal", "c_mktsegment", "o_orderstatus"]


@query("propensity_coefficients")
def _(spark, sf):
    df = study(spark, sf).drop("ps")
    return c.propensity_coefficients(df, c.propensity(df, "treated", COVARIATES)[1])


@query("propensity_quality")
def _(spark, sf):
    return c.propensity_quality(c.propensity(study(spark, sf).drop("ps"), "treated", COVARIATES)[0], "treated")


@query("propensity_plain_saturated", f"""WITH d AS (SELECT {TREATED} AS t, o_orderstatus AS s FROM orders), g AS (SELECT s, avg(t) AS p FROM d GROUP BY 1)
    SELECT o_orderstatus, count(*) AS n, round(max(p), 8) AS ps FROM orders JOIN g ON s = o_orderstatus GROUP BY 1""")
def _(spark, sf):
    scored, _ = c.propensity(table(spark, sf, "orders").withColumn("treated", F.expr(TREATED)), "treated", ["o_orderstatus"], "plain")
    return scored.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.max("ps"), 8).alias("ps"))


@query("support_trimming", BASE + """, l AS (SELECT greatest(min(CASE WHEN treated = 1 THEN ps END), min(CASE WHEN treated = 0 THEN ps END)) AS lo,
    least(max(CASE WHEN treated = 1 THEN ps END), max(CASE WHEN treated = 0 THEN ps END)) AS hi FROM d) SELECT id, treated FROM d, l WHERE ps BETWEEN lo AND hi""")
def _(spark, sf):
    return c.trim_support(study(spark, sf), "treated").select("id", "treated")


@query("support_summary", BASE + """, l AS (SELECT greatest(min(CASE WHEN treated = 1 THEN ps END), min(CASE WHEN treated = 0 THEN ps END)) AS lo,
    least(max(CASE WHEN treated = 1 THEN ps END), max(CASE WHEN treated = 0 THEN ps END)) AS hi FROM d) SELECT round(max(lo), 8) AS support_low, round(max(hi), 8) AS support_high,
    count(*) AS rows_before, count(CASE WHEN ps < lo OR ps > hi THEN 1 END) AS excluded, round(count(CASE WHEN ps < lo OR ps > hi THEN 1 END) * 100.0 / count(*), 6) AS excluded_percent FROM d, l""")
def _(spark, sf):
    return rounded(rounded(c.support_summary(study(spark, sf), "treated"), "support_low", "support_high", digits=8), "excluded_percent")


@query("smart_caliper", BASE + """, p AS (SELECT least(greatest(ps, 1e-6), 1 - 1e-6) AS p FROM d), s AS (SELECT stddev_pop(ln(p / (1 - p))) AS sd, median(p) AS m FROM p)
    SELECT round(abs(1 / (1 + exp(-(ln(m / (1 - m)) + 0.2 * sd))) - m), 8) AS caliper, round(sd, 8) AS sd_logit FROM s""")
def _(spark, sf):
    return rounded(c.smart_caliper(study(spark, sf)), "caliper", "sd_logit", digits=8)


@query("match_with_replacement", BASE + """, r AS (SELECT a.id AS treated_id, b.id AS control_id, round(abs(a.ps - b.ps), 9) AS distance, row_number() OVER
    (PARTITION BY a.id ORDER BY abs(a.ps - b.ps), b.id) AS k FROM d a JOIN d b ON a.treated = 1 AND b.treated = 0 AND abs(a.ps - b.ps) <= 0.01) SELECT treated_id, control_id, distance FROM r WHERE k <= 2""")
def _(spark, sf):
    return rounded(m.match_with_replacement(units(spark, sf), 2, 0.01), "distance", digits=9)


def greedy_sql(k: int, caliper: str = "'infinity'::DOUBLE", stratum: str = "'all'") -> str:
    """The sequential matching, one pick a step: treated units from the highest score down, each taking the nearest free control
    above or below it. The free controls of a stratum are the ones in a text with a sign per control, in score order."""
    return BASE.replace("WITH d", "WITH RECURSIVE d") + f""", o AS (SELECT *, {stratum} AS s, count(*) FILTER (treated = 0) OVER (PARTITION BY {stratum} ORDER BY ps DESC) AS above FROM d),
    c AS (SELECT s, list(id ORDER BY ps DESC, id) AS cid, list(ps ORDER BY ps DESC, id) AS cps FROM o WHERE treated = 0 GROUP BY 1),
    t AS (SELECT s, list(id ORDER BY ps DESC, id) AS tid, list(ps ORDER BY ps DESC, id) AS tps, list(above ORDER BY ps DESC, id) AS place FROM o WHERE treated = 1 GROUP BY 1),
    u AS (SELECT * FROM t JOIN c USING (s)),
    r AS (SELECT s, CAST(0 AS BIGINT) AS n, repeat('1', len(cid)) AS free, CAST(NULL AS BIGINT) AS pick FROM u UNION ALL
        SELECT s, n + 1, CASE WHEN pick IS NULL THEN free ELSE left(free, pick - 1) || '0' || substr(free, pick + 1) END, pick FROM (
        SELECT s, n, free, CAST(CASE WHEN least(up, down) <= {caliper} AND least(up, down) < 'infinity'::DOUBLE THEN CASE WHEN up <= down THEN hi ELSE lo END END AS BIGINT) AS pick FROM (
        SELECT s, n, free, hi, lo, coalesce(cps[hi] - score, 'infinity'::DOUBLE) AS up, coalesce(score - cps[lo], 'infinity'::DOUBLE) AS down FROM (
        SELECT s, n, free, cps, tps[n // {k} + 1] AS score, place[n // {k} + 1] + 1 - nullif(strpos(reverse(left(free, place[n // {k} + 1])), '1'), 0) AS hi,
            place[n // {k} + 1] + nullif(strpos(substr(free, place[n // {k} + 1] + 1), '1'), 0) AS lo FROM r JOIN u USING (s) WHERE n < {k} * len(tid)))))
    SELECT tid[(n - 1) // {k} + 1] AS treated_id, cid[pick] AS control_id, round(abs(cps[pick] - tps[(n - 1) // {k} + 1]), 9) AS distance FROM r JOIN u USING (s) WHERE pick IS NOT NULL"""


@query("match_greedy_caliper", greedy_sql(1, "0.01"))
def _(spark, sf):
    return rounded(m.match_without_replacement(units(spark, sf), 1, 0.01), "distance", digits=9)


@query("match_greedy_one_to_two", greedy_sql(2))
def _(spark, sf):
    return rounded(m.match_without_replacement(units(spark, sf), 2), "distance", digits=9)


EXACT = BASE + """, r AS (SELECT id, treated, c_mktsegment || '|' || o_orderstatus AS k, row_number() OVER (PARTITION BY c_mktsegment, o_orderstatus, treated ORDER BY id) AS n FROM d),
    p AS (SELECT a.id AS treated_id, b.id AS control_id FROM r a JOIN r b ON a.k = b.k AND a.n = b.n AND a.treated = 1 AND b.treated = 0)"""


def exact_pairs(spark, sf):
    return m.match_exact(units(spark, sf, ["c_mktsegment", "o_orderstatus"]))


@query("match_exact", EXACT + " SELECT *, CAST(0 AS DOUBLE) AS distance FROM p")
def _(spark, sf):
    return exact_pairs(spark, sf)


@query("match_exact_then_score", greedy_sql(1, "0.01", "c_mktsegment"))
def _(spark, sf):
    return rounded(m.match_without_replacement(units(spark, sf, ["c_mktsegment"]), 1, 0.01), "distance", digits=9)


@query("match_mahalanobis_replacement", """WITH d AS (SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS t, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier), m AS (SELECT var_samp(a) AS va,
    var_samp(b) AS vb, covar_samp(a, b) AS vab FROM d), r AS (SELECT x.id AS treated_id, y.id AS control_id, sqrt((vb * (x.a - y.a) ** 2 - 2 * vab * (x.a - y.a) * (x.b - y.b) + va * (x.b - y.b) ** 2)
    / (va * vb - vab * vab)) AS distance FROM d x, d y, m WHERE x.t AND NOT y.t) SELECT treated_id, control_id, round(distance, 7) AS distance FROM r
    QUALIFY row_number() OVER (PARTITION BY treated_id ORDER BY round(distance, 9), control_id) = 1""")
def _(spark, sf):
    df = table(spark, sf, "supplier").withColumn("t", F.expr("IF(s_suppkey % 3 = 0, 1, 0)"))
    return rounded(m.match_mahalanobis(df, "s_suppkey", "t", ["s_acctbal", "s_nationkey"]), "distance", digits=7)


# Treated units in id order take the nearest control that is still free, step by step.
@query("match_mahalanobis_once", """WITH RECURSIVE d AS (SELECT c_custkey AS id, c_custkey % 4 = 0 AS t, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer), m AS (SELECT var_samp(a) AS va,
    var_samp(b) AS vb, covar_samp(a, b) AS vab FROM d), c AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM d WHERE NOT t), x AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM d WHERE t),
    e AS (SELECT x.n, c.pos, c.id AS cid, sqrt((vb * (x.a - c.a) ** 2 - 2 * vab * (x.a - c.a) * (x.b - c.b) + va * (x.b - c.b) ** 2) / (va * vb - vab * vab)) AS distance FROM x, c, m),
    l AS (SELECT n, list(pos ORDER BY distance, cid) AS near FROM e WHERE distance <= 1 GROUP BY 1), u AS (SELECT x.n, l.near FROM x LEFT JOIN l USING (n)),
    r AS (SELECT CAST(0 AS BIGINT) AS n, repeat('1', (SELECT count(*) FROM c)) AS free, CAST(NULL AS BIGINT) AS pick UNION ALL
        SELECT n, CASE WHEN pick IS NULL THEN free ELSE left(free, pick - 1) || '0' || substr(free, pick + 1) END, pick FROM (
        SELECT u.n, r.free, list_filter(u.near, lambda p: substr(r.free, p, 1) = '1')[1] AS pick FROM r JOIN u ON u.n = r.n + 1))
    SELECT x.id AS treated_id, c.id AS control_id, round(e.distance, 7) AS distance FROM r JOIN x USING (n) JOIN c ON c.pos = r.pick JOIN e ON e.n = r.n AND e.pos = r.pick""")
def _(spark, sf):
    df = table(spark, sf, "customer").withColumn("t", F.expr("IF(c_custkey % 4 = 0, 1, 0)"))
    return rounded(m.match_mahalanobis(df, "c_custkey", "t", ["c_acctbal", "c_nationkey"], m.mahalanobis_caliper(0.05), False), "distance", digits=7)


@query("match_summary", EXACT + """, t AS (SELECT sum(treated) AS t FROM d) SELECT count(*) AS pairs, count(DISTINCT treated_id) AS matched_treated, CAST(max(t) - count(*) AS BIGINT) AS unmatched_treated,
    round(count(*) * 100.0 / max(t), 6) AS match_rate FROM p, t""")
def _(spark, sf):
    return rounded(m.match_summary(units(spark, sf), exact_pairs(spark, sf)), "match_rate")


@query("matched_rows", EXACT + """, s AS (SELECT treated_id AS u, treated_id AS pair FROM p UNION ALL SELECT control_id, treated_id FROM p) SELECT pair AS _pair_id, treated, y FROM s JOIN d ON u = id""")
def _(spark, sf):
    return m.matched_rows(study(spark, sf), "id", exact_pairs(spark, sf)).select("_pair_id", "treated", "y")


MATCHED = EXACT + ", s AS (SELECT treated_id AS u, treated_id AS pair FROM p UNION ALL SELECT control_id, treated_id FROM p), w AS (SELECT pair, d.* FROM s JOIN d ON u = id)"


def matched(spark, sf):
    return m.matched_rows(study(spark, sf), "id", exact_pairs(spark, sf))


@query("balance_table", MATCHED + """, b AS (SELECT abs(avg(CASE WHEN treated = 1 THEN c_acctbal END) - avg(CASE WHEN treated = 0 THEN c_acctbal END)) / sqrt((var_samp(CASE WHEN treated = 1 THEN c_acctbal END)
    + var_samp(CASE WHEN treated = 0 THEN c_acctbal END)) / 2) AS s FROM d), a AS (SELECT abs(avg(CASE WHEN treated = 1 THEN c_acctbal END) - avg(CASE WHEN treated = 0 THEN c_acctbal END))
    / sqrt((var_samp(CASE WHEN treated = 1 THEN c_acctbal END) + var_samp(CASE WHEN treated = 0 THEN c_acctbal END)) / 2) AS s FROM w)
    SELECT 'c_acctbal' AS covariate, round(b.s, 8) AS smd_before, round(a.s, 8) AS smd_after, a.s < b.s AS improved, a.s < 0.1 AS balanced FROM a, b""")
def _(spark, sf):
    return rounded(c.balance_table(study(spark, sf), matched(spark, sf), "treated", ["c_acctbal"]), "smd_before", "smd_after", digits=8)


@query("matched_effect", MATCHED + """, g AS (SELECT avg(CASE WHEN treated = 1 THEN y END) AS m1, avg(CASE WHEN treated = 0 THEN y END) AS m0, count(*) AS n FROM w), q AS (SELECT pair,
    sum((2 * treated - 1) * (y - CASE WHEN treated = 1 THEN m1 ELSE m0 END)) AS u FROM w, g GROUP BY 1), v AS (SELECT sum((u * 2 / n) ** 2) * (count(*) / (count(*) - 1.0)) * ((max(n) - 1.0) / (max(n) - 2.0)) AS v FROM q, g)
    SELECT 'ATT' AS estimand, n, round(m1 - m0, 5) AS estimate, round(sqrt(v), 4) AS std_error FROM g, v""")
def _(spark, sf):
    out = c.matched_effect(matched(spark, sf), "treated", "y").select("estimand", "n", "estimate", "std_error")
    return rounded(rounded(out, "estimate", digits=5), "std_error", digits=4)


@query("matched_effect_binary", MATCHED + """, g AS (SELECT avg(CASE WHEN treated = 1 THEN big END) AS p1, avg(CASE WHEN treated = 0 THEN big END) AS p0 FROM w)
    SELECT round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 7) AS estimate, round(p1 / (1 - p1) / (p0 / (1 - p0)), 7) AS ratio FROM g""")
def _(spark, sf):
    return rounded(c.matched_effect(matched(spark, sf), "treated", "big", "binary").select("estimate", "ratio"), "estimate", "ratio", digits=7)


@query("outcome_rates", MATCHED + " SELECT treated AS arm, count(*) AS n, round(avg(big), 8) AS outcome_mean FROM w GROUP BY 1")
def _(spark, sf):
    return rounded(c.outcome_rates(matched(spark, sf), "treated", "big"), "outcome_mean", digits=8)


WEIGHTS = BASE + """, x AS (SELECT *, CASE WHEN treated = 1 THEN {t} ELSE {c} END AS w0 FROM (SELECT * REPLACE (least(greatest(ps, 1e-6), 1 - 1e-6) AS ps) FROM d)), k AS (SELECT quantile_cont(w0, 0.99) AS k FROM x),
    w AS (SELECT *, least(w0, k) AS w FROM x, k), g AS (SELECT sum(w * treated * y) / sum(w * treated) AS m1, sum(w * (1 - treated) * y) / sum(w * (1 - treated)) AS m0, sum(w * treated) AS w1, sum(w * (1 - treated)) AS w0, count(*) AS n FROM w)"""
HC1 = """, v AS (SELECT sum(CASE WHEN treated = 1 THEN (w * (y - m1) / g.w1) ** 2 ELSE (w * (y - m0) / g.w0) ** 2 END) * max(n) / (max(n) - 2.0) AS v FROM w, g)
    SELECT '{e}' AS estimand, n, round(m1 - m0, 4) AS estimate, round(sqrt(v), 4) AS std_error FROM g, v"""


@query("weighted_effect_ate", WEIGHTS.format(t="1 / ps", c="1 / (1 - ps)") + HC1.format(e="ATE"))
def _(spark, sf):
    out = c.weighted_effect(study(spark, sf), "treated", "y").select("estimand", "n", "estimate", "std_error")
    return rounded(out, "estimate", "std_error", digits=4)


@query("weighted_effect_att", WEIGHTS.format(t="1", c="ps / (1 - ps)") + HC1.format(e="ATT"))
def _(spark, sf):
    out = c.weighted_effect(study(spark, sf), "treated", "y", estimand="ATT").select("estimand", "n", "estimate", "std_error")
    return rounded(out, "estimate", "std_error", digits=4)


@query("weighted_effect_binary", WEIGHTS.format(t="1 / ps", c="1 / (1 - ps)").replace("treated * y", "treated * big").replace("treated) * y", "treated) * big")
    + """, v AS (SELECT sum(CASE WHEN treated = 1 THEN (w * (big - m1) / (g.w1 * m1 * (1 - m1))) ** 2 ELSE (w * (big - m0) / (g.w0 * m0 * (1 - m0))) ** 2 END) * max(n) / (max(n) - 2.0) AS v FROM w, g)
    SELECT 'ATE' AS estimand, n, round(ln(m1 / (1 - m1)) - ln(m0 / (1 - m0)), 6) AS estimate, round(sqrt(v), 6) AS std_error, round(m1 / (1 - m1) / (m0 / (1 - m0)), 6) AS ratio FROM g, v""")
def _(spark, sf):
    out = c.weighted_effect(study(spark, sf), "treated", "big", "binary").select("estimand", "n", "estimate", "std_error", "ratio")
    return rounded(out, "estimate", "std_error", "ratio")


@query("effective_sample_size", WEIGHTS.format(t="1", c="ps / (1 - ps)") + """ SELECT treated AS arm, count(*) AS n, round(sum(w), 4) AS weight_sum, round(sum(w) ** 2 / sum(w * w), 4) AS effective_n,
    round(max(w), 6) AS max_weight FROM w GROUP BY 1""")
def _(spark, sf):
    out = c.effective_sample_size(c.with_weights(study(spark, sf), "treated", "ATT"), "treated")
    return rounded(rounded(out, "weight_sum", "effective_n", digits=4), "max_weight")


COMPARED = MATCHED + """, g AS (SELECT avg(CASE WHEN treated = 1 THEN y END) AS m1, avg(CASE WHEN treated = 0 THEN y END) AS m0, count(*) AS n FROM w)"""


@query("effect_comparison", f"""SELECT 'ATT' AS estimand, 'matching' AS method, n, round(m1 - m0, 4) AS estimate FROM ({COMPARED} SELECT * FROM g)
    UNION ALL SELECT 'ATE', 'weighting', n, round(m1 - m0, 4) FROM ({WEIGHTS.format(t="1 / ps", c="1 / (1 - ps)")} SELECT * FROM g)""")
def _(spark, sf):
    out = c.compare_effects(c.matched_effect(matched(spark, sf), "treated", "y"), c.weighted_effect(study(spark, sf), "treated", "y"))
    return rounded(out.select("estimand", "method", "n", "estimate"), "estimate", digits=4)


@query("weight_histogram", WEIGHTS.format(t="1 / ps", c="1 / (1 - ps)") + """, l AS (SELECT min(w) AS lo, max(w) AS hi FROM w) SELECT treated, least(CAST(floor((w - lo) / (hi - lo) * 30) AS INT), 29) AS bin, count(*) AS count FROM w, l GROUP BY 1, 2""")
def _(spark, sf):
    from colonnade.operators import charts
    return charts.histogram(c.with_weights(study(spark, sf), "treated"), "weight", 30, ["treated"]).where("count > 0").select("treated", "bin", "count")


@query("subgroup_effects", MATCHED + """ SELECT o_orderstatus AS level, sum(treated)::BIGINT AS n_treated, sum(1 - treated)::BIGINT AS n_control,
    round(avg(CASE WHEN treated = 1 THEN y END) - avg(CASE WHEN treated = 0 THEN y END), 4) AS effect FROM w GROUP BY 1""")
def _(spark, sf):
    out = c.subgroup_effects(matched(spark, sf), "treated", "y", "o_orderstatus").select("level", "n_treated", "n_control", "effect")
    return rounded(out, "effect", digits=4)


@query("placebo_outcome", MATCHED + " SELECT 'c_acctbal' AS placebo, round(avg(CASE WHEN treated = 1 THEN c_acctbal END) - avg(CASE WHEN treated = 0 THEN c_acctbal END), 4) AS estimate FROM w")
def _(spark, sf):
    return rounded(c.placebo_outcome(matched(spark, sf), "treated", "c_acctbal").select("placebo", "estimate"), "estimate", digits=4)


def bounds_sql(y: str, counts: str, tail) -> str:
    """Both bounds from the upper tail at the odds gamma and 1 / gamma, and the first gamma whose upper bound passes 0.05."""
    return EXACT + f""", e AS (SELECT CAST(a.{y} AS DOUBLE) - CAST(b.{y} AS DOUBLE) AS e FROM p JOIN d a ON a.id = treated_id JOIN d b ON b.id = control_id WHERE a.{y} <> b.{y}), {counts},
    g AS (SELECT CAST(unnest([1.0, 1.5, 2, 2.5, 3, 4]) AS DOUBLE) AS gamma), t AS (SELECT gamma, {tail("gamma / (1 + gamma)")} AS u, {tail("1 / (1 + gamma)")} AS v FROM g, w),
    z AS (SELECT gamma, least(u, v) AS p_low, greatest(u, v) AS p_high FROM t)
    SELECT gamma, round(p_low, 6) AS p_low, round(p_high, 6) AS p_high, (SELECT min(gamma) FROM z WHERE p_high > 0.05) AS critical_gamma FROM z"""


def normal_tail(p: str) -> str:
    z = f"((up - {p} * s1) / sqrt({p} * (1 - {p}) * s2))"
    return f"(0.5 - sign({z}) * 0.5 * ({erf_sql(f'(abs({z}) / sqrt(2))')}))"


def binomial_tail(p: str) -> str:
    return f"list_sum(list_transform(range(CAST(up AS BIGINT), CAST(n AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"


SIGNED_RANKS = """k AS (SELECT e, (rank() OVER (ORDER BY abs(e)) + (count(*) OVER (ORDER BY abs(e)))) / 2.0 AS r FROM e),
    w AS (SELECT sum(CASE WHEN e > 0 THEN r ELSE 0 END) AS up, sum(r) AS s1, sum(r * r) AS s2 FROM k)"""


@query("rosenbaum_bounds", bounds_sql("y", SIGNED_RANKS, normal_tail))
def _(spark, sf):
    pairs = c.pair_outcomes(study(spark, sf), "id", "y", exact_pairs(spark, sf))
    return rounded(c.rosenbaum_bounds(pairs, "treated_outcome", "control_outcome"), "p_low", "p_high")


@query("rosenbaum_bounds_binary", bounds_sql("big", "w AS (SELECT count(*) AS n, count(CASE WHEN e > 0 THEN 1 END) AS up FROM e)", binomial_tail))
def _(spark, sf):
    pairs = c.pair_outcomes(study(spark, sf), "id", "big", exact_pairs(spark, sf))
    return rounded(c.rosenbaum_bounds(pairs, "treated_outcome", "control_outcome", "binary"), "p_low", "p_high")


# ---------------------------------------------------------------- mixed models


@query("group_sizes", """WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, min(n) AS smallest, max(n) AS largest,
    round(avg(n), 6) AS mean_size, count(*) < 5 AS few_groups, min(n) < 2 AS tiny_groups FROM g""")
def _(spark, sf):
    return rounded(mixed.group_sizes(table(spark, sf, "lineitem"), "l_suppkey"), "mean_size")


def null_model_sql(rounds: int = 7) -> str:
    """Maximum likelihood over the variance ratio: a grid on the log scale, then ever finer ones around the best point."""
    ctes = [
        "y AS (SELECT user_id AS g, value - (SELECT avg(value) FROM events) AS y FROM events)", "o AS (SELECT count(*) AS nn, sum(y * y) AS yy FROM y)",
        "k AS (SELECT n, count(*) AS k, sum(s) AS s, sum(s * s) AS ss FROM (SELECT g, count(*) AS n, sum(y) AS s FROM y GROUP BY 1) GROUP BY 1)",
    ]
    step = (math.log(1e3) - math.log(1e-7)) / 40
    grid = f"SELECT ln(1e-7) + {step!r} * range AS x FROM range(41)"
    for r in range(rounds):
        ctes += [
            f"l{r} AS (SELECT x, exp(x) AS lam FROM ({grid}))",
            f"""p{r} AS (SELECT x, lam, any_value(nn) AS nn, sum(k * ln(1 + n * lam)) AS logdet, any_value(yy) - sum(lam / (1 + n * lam) * ss) - sum(s / (1 + n * lam)) ** 2 / sum(k * n / (1 + n * lam)) AS rss
                FROM l{r}, k, o GROUP BY 1, 2)""",
            f"b{r} AS (SELECT *, -nn / 2.0 * (ln(2 * pi() * rss / nn) + 1) - logdet / 2 AS ll, rss / nn AS s2 FROM p{r} ORDER BY ll DESC LIMIT 1)",
        ]
        step /= 20
        grid = f"SELECT b{r}.x + {step!r} * (range - 20) AS x FROM b{r}, range(41)"
    return f"""WITH {', '.join(ctes)} SELECT round(lam * s2, 3) AS var_intercept, round(s2, 3) AS var_residual, round(lam / (1 + lam), 7) AS icc, CAST(NULL AS DOUBLE) AS var_slope, CAST(NULL AS DOUBLE) AS covariance,
        CAST(NULL AS DOUBLE) AS correlation, round(ll, 4) AS log_likelihood, round(6 - 2 * ll, 4) AS aic FROM b{rounds - 1}"""


@query("mixed_null_model", null_model_sql())
def _(spark, sf):
    df = table(spark, sf, "events")
    out = rounded(mixed.variance_components(df, mixed.null_model(df, "value", "user_id")), "var_intercept", "var_residual", digits=3)
    return rounded(rounded(out, "icc", digits=7), "log_likelihood", "aic", digits=4)


@query("mixed_random_intercept")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return mixed.mixed_coefficients(df, mixed.fit_random_intercept(df, "l_extendedprice", ["l_quantity", "l_linestatus"], "l_partkey"))


@query("mixed_random_slope")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return mixed.variance_components(df, mixed.fit_random_slope(df, "l_extendedprice", ["l_quantity"], "l_partkey", "l_quantity"))


@query("mixed_model_comparison")
def _(spark, sf):
    return mixed.compare_models(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "l_partkey")


@query("mixed_group_effects")
def _(spark, sf):
    return mixed.random_intercepts(mixed.fit_random_intercept(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "l_partkey"))


@query("mixed_residuals_by_group")
def _(spark, sf):
    return mixed.residuals_by_group(mixed.fit_random_intercept(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "l_suppkey"))


@query("mixed_normality")
def _(spark, sf):
    return mixed.normality(mixed.fit_random_intercept(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "l_suppkey"))


@query("gee_binomial")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("bought", F.expr("IF(event_type = 'purchase', 1, 0)"))
    return mixed.gee_coefficients(df, mixed.fit_gee(df, "bought", ["value"], "user_id", "binomial"))


@query("gee_summary")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("bought", F.expr("IF(event_type = 'purchase', 1, 0)"))
    return mixed.gee_summary(df, "bought", ["value"], "user_id", "binomial")


@query("gee_poisson")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("units", F.col("l_quantity"))
    return mixed.gee_coefficients(df, mixed.fit_gee(df, "units", ["l_linestatus"], "l_suppkey", "poisson"))


@query("gee_residuals")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("bought", F.expr("IF(event_type = 'purchase', 1, 0)"))
    return mixed.gee_residuals(mixed.fit_gee(df, "bought", ["value"], "user_id", "binomial"))
