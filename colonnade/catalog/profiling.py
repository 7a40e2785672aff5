"""Profiling and quality queries (counts, types, uniqueness, outliers)."""

from pyspark.sql import functions as F

from colonnade.catalog.base import (
    DIRTY_LINEITEM, DIRTY_SQL, DUPED_SQL, TAILED_SQL, dirty_lineitem, duped_orders, quantile_sql, query, table, tailed_orders,
)
from colonnade.context import DatasetContext
from colonnade.operators import profile

DIRTY = [n for _, n in DIRTY_LINEITEM]
DIRTY_TYPES = {
    "l_orderkey": "bigint", "l_suppkey": "bigint", "quantity": "double", "price": "double", "discount": "double",
    "tax": "double", "returnflag": "string", "linestatus": "string", "fixed": "string",
}
NUM = ["quantity", "price", "discount", "tax"]


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def union_sql(template: str, cols) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


@query(
    "core_metrics",
    f"""WITH d AS ({DUPED_SQL}) SELECT (SELECT count(*) FROM d) AS row_count, CAST(0 AS BIGINT) AS missing_cells,
    (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows,
    4 AS column_count, CAST(0 AS DOUBLE) AS missing_percent""",
)
def _(spark, sf):
    return profile.core_metrics(duped_orders(spark, sf))


MISSING = " + ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)" for c in DIRTY)


@query(
    "core_metrics_without_duplicates",
    f"""WITH d AS ({DIRTY_SQL}) SELECT count(*) AS row_count, {MISSING} AS missing_cells, 9 AS column_count,
    round(({MISSING}) * 100.0 / (count(*) * 9), 6) AS missing_percent FROM d""",
)
def _(spark, sf):
    return rounded(profile.core_metrics(dirty_lineitem(spark, sf), include_duplicates=False), "missing_percent")


@query(
    "column_type_lists",
    "SELECT * FROM (VALUES " + ", ".join(
        f"('{c}', '{t}', '{'categorical' if t == 'string' else 'numeric'}')" for c, t in DIRTY_TYPES.items()
    ) + ") v(\"column\", data_type, column_class)",
)
def _(spark, sf):
    return DatasetContext.of(dirty_lineitem(spark, sf)).column_types()


@query("column_type_frequency", """SELECT * FROM (VALUES ('bigint', 2), ('double', 4), ('string', 3)) v(data_type, "columns")""")
def _(spark, sf):
    return profile.type_frequency(dirty_lineitem(spark, sf))


@query(
    "profile_missing_report",
    f"WITH d AS ({DIRTY_SQL}) " + union_sql(
        """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percent FROM d""", DIRTY),
)
def _(spark, sf):
    return rounded(profile.missing_report(dirty_lineitem(spark, sf)), "missing_percent")


DTYPE_SQL = f"WITH d AS ({DIRTY_SQL}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS data_type, count({c}) AS non_null_count,
    count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percent,
    count(DISTINCT {c}) AS unique_values FROM d""" for c, t in DIRTY_TYPES.items())


@query("profile_dtype_report", DTYPE_SQL)
def _(spark, sf):
    return rounded(profile.dtype_report(dirty_lineitem(spark, sf)), "missing_percent")


@query(
    "profile_dtype_report_texts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS data_type, count({c}) AS non_null_count,
        count(*) - count({c}) AS missing_count, CAST(0 AS DOUBLE) AS missing_percent,
        count(DISTINCT {c}) AS unique_values FROM documents"""
        for c, t in [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                     ("n_chars", "bigint")]),
)
def _(spark, sf):
    return profile.dtype_report(table(spark, sf, "documents"))


@query(
    "profile_unique_report",
    f"WITH d AS ({DIRTY_SQL}) " + union_sql(
        """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values,
        round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_percent FROM d""", DIRTY),
)
def _(spark, sf):
    return rounded(profile.unique_report(dirty_lineitem(spark, sf)), "unique_percent")


@query(
    "quality_status",
    f"""WITH d AS ({DIRTY_SQL}), m AS (""" + union_sql("SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM d", DIRTY)
    + """) SELECT round(max(p), 6) AS max_missing_percent, CASE WHEN max(p) < 5 THEN 'Good' WHEN max(p) <= 30
    THEN 'Warning' ELSE 'Critical' END AS status FROM m""",
)
def _(spark, sf):
    return rounded(profile.dataset_status(dirty_lineitem(spark, sf)), "max_missing_percent")


EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
FLAGS_SQL = union_sql(
    """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values,
    count(DISTINCT {c}) * 1.0 / count(*) > 0.9 OR '{c}' LIKE '%id%' OR '{c}' LIKE '%code%' OR '{c}' LIKE '%number%'
    AS possible_id, count(DISTINCT {c}) <= 1 AS constant,
    '{c}' IN ('event_type', 'props') AND count(DISTINCT {c}) > 50 AS high_cardinality FROM events""", EVENT_COLS)


@query("quality_column_flags", FLAGS_SQL)
def _(spark, sf):
    return profile.column_flags(table(spark, sf, "events"), 50)


@query("possible_id_columns", f'SELECT "column", unique_values FROM ({FLAGS_SQL}) WHERE possible_id')
def _(spark, sf):
    flags = profile.column_flags(table(spark, sf, "events"))
    return flags.where("possible_id").select("column", "unique_values")


@query("high_cardinality_columns", f'SELECT "column", unique_values FROM ({FLAGS_SQL}) WHERE high_cardinality')
def _(spark, sf):
    flags = profile.column_flags(table(spark, sf, "events"), 50)
    return flags.where("high_cardinality").select("column", "unique_values")


@query(
    "constant_columns",
    f"WITH d AS ({DIRTY_SQL}) SELECT * FROM (" + union_sql(
        """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values FROM d""", DIRTY) + ") WHERE unique_values <= 1",
)
def _(spark, sf):
    flags = profile.column_flags(dirty_lineitem(spark, sf))
    return flags.where("constant").select("column", "unique_values")


DATE_EXPRS = [
    ("CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END", "mostly_dates"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END", "some_dates"),
    ("o_orderpriority", "priority"),
]


@query(
    "date_like_columns",
    "WITH d AS (SELECT " + ", ".join(f"{e} AS {n}" for e, n in DATE_EXPRS) + " FROM orders) " + union_sql(
        """SELECT '{c}' AS "column", round(count(TRY_CAST({c} AS DATE)) * 1.0 / count({c}), 6) AS parsed_share,
        count(TRY_CAST({c} AS DATE)) * 1.0 / count({c}) > 0.7 AS date_like FROM d""",
        ["mostly_dates", "some_dates", "priority"]),
)
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for e, n in DATE_EXPRS])
    return rounded(profile.date_like_columns(df), "parsed_share")


def bounds_sql(cols, source):
    return f"WITH d AS ({source}), b AS (" + union_sql(
        """SELECT '{c}' AS "column", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d""", cols
    ) + ")"


@query(
    "outliers_iqr",
    bounds_sql(["total", "wave"], TAILED_SQL) + ", o AS (" + union_sql(
        """SELECT '{c}' AS "column", count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)
        THEN 1 END) AS outliers, count({c}) AS n FROM d, b WHERE "column" = '{c}'""", ["total", "wave"])
    + """) SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
    round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper, outliers,
    round(outliers * 100.0 / n, 6) AS outlier_percent FROM b JOIN o USING ("column")""",
)
def _(spark, sf):
    out = profile.outliers_iqr(tailed_orders(spark, sf), ["total", "wave"])
    return rounded(rounded(out, "outlier_percent"), "q1", "q3", "iqr", "lower", "upper", digits=4)


@query(
    "outliers_zscore",
    f"WITH d AS ({TAILED_SQL}), m AS (SELECT avg(total) AS mt, stddev_samp(total) AS st, avg(wave) AS mw, "
    "stddev_samp(wave) AS sw FROM d) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(max({m}), 4) AS mean, round(max({s}), 4) AS std, CAST(3 AS DOUBLE) AS threshold,
        count(CASE WHEN abs({c} - {m}) / {s} > 3 THEN 1 END) AS outliers,
        round(count(CASE WHEN abs({c} - {m}) / {s} > 3 THEN 1 END) * 100.0 / count({c}), 6) AS outlier_percent
        FROM d, m""" for c, m, s in [("total", "mt", "st"), ("wave", "mw", "sw")]),
)
def _(spark, sf):
    out = profile.outliers_zscore(tailed_orders(spark, sf), ["total", "wave"])
    return rounded(rounded(out, "outlier_percent"), "mean", "std", digits=4)


NUM_PROFILE_SQL = f"WITH d AS ({DIRTY_SQL}) " + union_sql(
    """SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}), 4) AS std, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
    min({c}) AS min, max({c}) AS max, round(stddev_samp({c}) / avg({c}) * 100, 6) AS cv_percent, count({c}) AS n,
    round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
    round(quantile_cont({c}, 0.75), 4) AS q3 FROM d""", NUM)


@query("profile_numeric", NUM_PROFILE_SQL)
def _(spark, sf):
    out = profile.numeric_profile(dirty_lineitem(spark, sf), NUM)
    return rounded(rounded(out, "skewness", "kurtosis", "cv_percent"), "mean", "std", "q1", "median", "q3", digits=4)


@query(
    "profile_numeric_advice",
    f"WITH d AS ({TAILED_SQL}), p AS (" + union_sql(
        """SELECT '{c}' AS "column", skewness({c}) AS sk, kurtosis({c}) AS ku, (count(*) - count({c})) * 100.0 / count(*) AS ms,
        quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d""", ["total", "wave"]) + "), o AS ("
    + union_sql("""SELECT '{c}' AS "column", count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)
        THEN 1 END) AS outliers FROM d, p WHERE "column" = '{c}'""", ["total", "wave"])
    + """) SELECT "column", 'high skewness' AS issue, round(sk, 6) AS measure, 'High' AS priority FROM p WHERE abs(sk) > 1
    UNION ALL SELECT "column", 'moderate skewness', round(sk, 6), 'Medium' FROM p WHERE abs(sk) > 0.5 AND abs(sk) <= 1
    UNION ALL SELECT "column", 'high kurtosis', round(ku, 6), 'Medium' FROM p WHERE abs(ku) > 3
    UNION ALL SELECT "column", 'missing values', round(ms, 6), CASE WHEN ms > 30 THEN 'High' WHEN ms > 5 THEN 'Medium'
      ELSE 'Low' END FROM p WHERE ms > 0
    UNION ALL SELECT "column", 'outliers', CAST(outliers AS DOUBLE), 'Medium' FROM o WHERE outliers > 0""",
)
def _(spark, sf):
    return rounded(profile.numeric_advice(tailed_orders(spark, sf), ["total", "wave"]), "measure")


CAT_SQL = """SELECT '{c}' AS "column", (SELECT count({c}) FROM d) AS n, (SELECT count(*) - count({c}) FROM d) AS n_missing,
    count(*) AS n_unique, (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
    round(max(c) * 100.0 / sum(c), 6) AS mode_percent, round(-sum(p * log2(p)), 6) AS entropy,
    round(-sum(p * log2(p)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 6) AS normalized_entropy
    FROM (SELECT count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM d WHERE {c} IS NOT NULL GROUP BY {c})"""


@query("profile_categorical", f"WITH d AS ({DIRTY_SQL}) " + union_sql(CAT_SQL, ["returnflag", "linestatus"]))
def _(spark, sf):
    out = profile.categorical_profile(dirty_lineitem(spark, sf), ["returnflag", "linestatus"])
    return rounded(out, "mode_percent", "entropy", "normalized_entropy")


@query(
    "profile_categorical_advice",
    f"""WITH d AS (SELECT p_brand, CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE p_type END AS p_type,
      CASE WHEN p_partkey % 50 = 0 THEN 'odd' ELSE 'usual' END AS kind FROM part),
    c AS (""" + union_sql("""SELECT '{c}' AS "column", {c} AS v, count(*) AS c FROM d GROUP BY {c}""", ["p_brand", "p_type", "kind"])
    + """), s AS (SELECT "column", sum(CASE WHEN v IS NULL THEN c ELSE 0 END) * 100.0 / sum(c) AS ms,
      sum(CASE WHEN v IS NOT NULL THEN c END) AS n, count(v) AS u FROM c GROUP BY 1),
    r AS (SELECT c."column", count(CASE WHEN c.c * 100.0 / s.n < 5 THEN 1 END) AS rare, max(c.c * 100.0 / s.n) AS top
      FROM c JOIN s USING ("column") WHERE v IS NOT NULL GROUP BY 1)
    SELECT "column", 'missing values' AS issue, round(ms, 6) AS measure, CASE WHEN ms > 30 THEN 'High' WHEN ms > 5
      THEN 'Medium' ELSE 'Low' END AS priority FROM s WHERE ms > 0
    UNION ALL SELECT "column", 'rare categories', CAST(rare AS DOUBLE), 'Medium' FROM r WHERE rare > 0
    UNION ALL SELECT "column", 'high cardinality', CAST(u AS DOUBLE), 'Medium' FROM s WHERE u > 50
    UNION ALL SELECT "column", 'dominant category', round(top, 6), 'High' FROM r WHERE top > 90""",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_brand", "CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE p_type END AS p_type",
        "CASE WHEN p_partkey % 50 = 0 THEN 'odd' ELSE 'usual' END AS kind")
    return rounded(profile.categorical_advice(df), "measure")


@query(
    "value_counts",
    """WITH c AS (SELECT p_brand AS value, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent
    FROM part GROUP BY 1) SELECT value, count, CAST(percent AS DOUBLE) AS percent,
    round(CAST(sum(percent) OVER (ORDER BY count DESC, value) AS DOUBLE), 2) AS cumulative_percent FROM c""",
)
def _(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), "p_brand")


@query(
    "rare_categories",
    """WITH c AS (SELECT p_brand AS value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
    FROM part GROUP BY 1) SELECT * FROM c WHERE percent < 5""",
)
def _(spark, sf):
    return rounded(profile.rare_categories(table(spark, sf, "part"), "p_brand"), "percent")


@query(
    "profile_summary_table",
    f"WITH d AS ({DIRTY_SQL}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS data_type, count({c}) AS n_valid,
        round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percent, count(DISTINCT {c}) AS n_unique, """
        + (f"""round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 6) AS skewness,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS mode,
        CASE WHEN abs(skewness({c})) > 1 THEN 'YES' ELSE 'NO' END AS needs_transform FROM d""" if t != "string" else
           f"""NULL, NULL, NULL, NULL, NULL, (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY 1
           ORDER BY count(*) DESC, 1 LIMIT 1), 'N/A' FROM d""") for c, t in DIRTY_TYPES.items()),
)
def _(spark, sf):
    out = profile.summary_table(dirty_lineitem(spark, sf))
    return rounded(rounded(out, "missing_percent", "skewness"), "mean", "std", digits=4)


@query(
    "describe_all",
    f"WITH d AS ({DIRTY_SQL}) " + " UNION ALL ".join(
        (f"""SELECT '{c}' AS "column", count({c}) AS count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
        CAST(NULL AS BIGINT) AS freq, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
        round(quantile_cont({c}, 0.75), 4) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM d""" if t != "string" else
         f"""SELECT '{c}', count({c}), count(DISTINCT {c}), (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY 1
         ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT max(n) FROM (SELECT count({c}) AS n FROM d GROUP BY {c})),
         NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d""") for c, t in DIRTY_TYPES.items()),
)
def _(spark, sf):
    return rounded(profile.describe_all(dirty_lineitem(spark, sf)), "mean", "std", "q1", "median", "q3", digits=4)


@query("qq_points", f"""WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS x, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
    g AS (SELECT CAST(floor(range * (n - 1) / 999.0 + 1e-9) AS BIGINT) + 1 AS i FROM range(1000), (SELECT count(*) AS n FROM orders)),
    p AS (SELECT i, x, CASE WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n) WHEN i = n THEN 0.5 ** (1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM o JOIN g USING (i))
    SELECT i AS rank, round(p, 8) AS probability, x AS sample_quantile, round({quantile_sql("p")}, 6) AS normal_quantile FROM p""")
def _(spark, sf):
    return rounded(rounded(profile.qq_points(table(spark, sf, "orders"), "o_totalprice"), "probability", digits=8), "normal_quantile")
