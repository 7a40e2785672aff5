"""Registry of runnable queries over the driver tables, each with an independent SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colonnade.functions.special import AS241

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables hold no nulls and no duplicates, so both are injected by expressions that mean the same in Spark SQL
# and in the check SQL. Each list is (expression, name).
DIRTY_LINEITEM = [
    ("l_orderkey", "l_orderkey"),
    ("l_suppkey", "l_suppkey"),
    ("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END", "quantity"),
    ("CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END", "price"),
    ("l_discount", "discount"),
    ("CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END", "tax"),
    ("CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END", "returnflag"),
    ("l_linestatus", "linestatus"),
    ("'x'", "fixed"),
]
# Order totals with a long right tail and a few far values, for the outlier operators.
TAILED_ORDERS = [
    ("o_orderkey", "o_orderkey"),
    ("CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 8 WHEN o_orderkey % 10 = 0 THEN NULL "
     "ELSE o_totalprice END", "total"),
    ("CAST(CASE WHEN o_orderkey % 101 = 0 THEN -5000 ELSE o_orderkey % 1000 END AS DOUBLE)", "wave"),
    ("o_orderpriority", "priority"),
    ("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END", "status"),
]


def select_list(exprs: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in exprs)


DIRTY_SQL = f"SELECT {select_list(DIRTY_LINEITEM)} FROM lineitem"
TAILED_SQL = f"SELECT {select_list(TAILED_ORDERS)} FROM orders"


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for e, n in DIRTY_LINEITEM])


def tailed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for e, n in TAILED_ORDERS])


# Orders with every twentieth order repeated (duplicates for the distinct-row operators).
DUPED_SQL = (
    "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders UNION ALL "
    "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 20 = 0"
)


def duped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cols = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    return orders.select(*cols).unionAll(orders.where("o_orderkey % 20 = 0").select(*cols))


def poly_sql(coefficients, x):
    """Horner form of a polynomial given lowest power first."""
    out = str(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c})"
    return out


def quantile_sql(p):
    """Normal quantile of the SQL expression ``p``."""
    q, r, t = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    mid, tail, far = (f"({poly_sql(n, x)} / {poly_sql(d, x)})" for (n, d), x in zip(AS241, (r, f"({t} - 1.6)", f"({t} - 5)"), strict=True))
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {mid} WHEN {t} <= 5 THEN sign({q}) * {tail} ELSE sign({q}) * {far} END"


def erf_sql(h):
    """Error function of the SQL expression ``h`` between 0 and about 4, by its series; 1 beyond."""
    return f"CASE WHEN {h} > 4 THEN 1 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: (-1) ** k * ({h}) ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) END"


def two_sided_sql(z):
    """Two-sided normal p-value of the SQL expression ``z``."""
    return f"(1 - {erf_sql(f'(abs({z}) / sqrt(2))')})"


def solve_ctes(name, source, k):
    """CTEs that solve the k linear equations of the one row of ``source`` (a0_0.. and b0..) by elimination: x0.. in ``name``."""
    out, last = [], source
    for s in range(k - 1):
        cells = []
        for i in range(k):
            cut = f" - a{i}_{s} / a{s}_{s} * " if i > s else None
            cells += [f"a{i}_{j}{cut}a{s}_{j} AS a{i}_{j}" if cut else f"a{i}_{j}" for j in range(k)]
            cells.append(f"b{i}{cut}b{s} AS b{i}" if cut else f"b{i}")
        out.append(f"{name}_e{s} AS (SELECT {', '.join(cells)} FROM {last})")
        last = f"{name}_e{s}"
    for i in reversed(range(k)):
        known = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, k))
        out.append(f"{name}_x{i} AS (SELECT *, (b{i}{known}) / a{i}_{i} AS x{i} FROM {last})")
        last = f"{name}_x{i}"
    return [*out, f"{name} AS (SELECT {', '.join(f'x{i}' for i in range(k))} FROM {last})"]


def logistic_ctes(rows, k, steps=8):
    """CTEs of unrolled Newton steps for y on x0..x{k-1} of ``rows``: coefficients x0.. in n{steps}, variances v0.. in var."""
    out = ["n0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS x{i}" for i in range(k)) + ")"]
    eta = " + ".join(f"r.x{i} * n.x{i}" for i in range(k))
    for s in range(steps):
        sums = [f"sum(m * (1 - m) * x{i} * x{j}) AS a{i}_{j}" for i in range(k) for j in range(k)] + [f"sum((y - m) * x{i}) AS b{i}" for i in range(k)]
        out.append(f"m{s} AS (SELECT r.*, 1 / (1 + exp(-({eta}))) AS m FROM {rows} r, n{s} n)")
        out.append(f"h{s} AS (SELECT {', '.join(sums)} FROM m{s})")
        out += solve_ctes(f"d{s}", f"h{s}", k)
        out.append(f"n{s + 1} AS (SELECT {', '.join(f'n.x{i} + d.x{i} AS x{i}' for i in range(k))} FROM n{s} n, d{s} d)")
    for i in range(k):
        unit = ", ".join(f"{float(i == j)} AS b{j}" for j in range(k))
        out.append(f"u{i} AS (SELECT * REPLACE ({unit}) FROM h{steps - 1})")
        out += solve_ctes(f"c{i}", f"u{i}", k)
    out.append("var AS (SELECT " + ", ".join(f"c{i}.x{i} AS v{i}" for i in range(k)) + " FROM " + ", ".join(f"c{i}" for i in range(k)) + ")")
    return out
