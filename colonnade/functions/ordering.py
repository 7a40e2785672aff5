"""Running totals and ranks over a global order, split across tasks.

A window without a partition key would send every row to one task. Here the rows are range-partitioned by the whole
order (groups included, so a hot group is spread as well), totals run inside each range, and the totals of the
earlier ranges are added. The range number of each row is fixed by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.context import free_names, ref
from colonnade.session import materialise


def _sort_column(key: str, suffix_desc: bool) -> Column:
    return ref(key).desc() if suffix_desc else ref(key).asc()


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, str],
    by: Sequence[str] = (),
    grand: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``{source: new name}`` in ``order`` within each ``by`` group.

    A leading ``-`` in ``order`` sorts that column downwards. The frame must be unique per (by, order): aggregate
    equal keys first. ``grand=True`` also adds ``<new name>_all``, the total of the group.
    """
    by = list(by)
    keys = [(o.lstrip("-"), o.startswith("-")) for o in order]
    sort = [_sort_column(k, d) for k, d in keys]
    names = list(sums.values())
    # Columns of its own, under names that neither the frame nor the results bear.
    here, there, *rest = free_names([*df.columns, *names], "_range", "_at", *[f"_{k}{i}" for k in ("run", "tot", "off") for i in range(len(names))], *[f"_by{i}" for i in range(len(by))])
    run, tot, off = (rest[k * len(names) : (k + 1) * len(names)] for k in range(3))
    groups = rest[3 * len(names) :]
    ranged = df.repartitionByRange(*[ref(b).asc() for b in by], *sort)
    ranged = materialise(ranged.withColumn(here, F.spark_partition_id()))
    inside = W.partitionBy(here, *[ref(b) for b in by]).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(ref(s)).over(inside).alias(r) for s, r in zip(sums, run, strict=True)])
    totals = ranged.groupBy(here, *[ref(b).alias(g) for b, g in zip(by, groups, strict=True)]).agg(
        *[F.sum(ref(s)).alias(t) for s, t in zip(sums, tot, strict=True)]
    )
    # At most one row per range and group it touches; the constant key only names the ungrouped case.
    keyed = groups or [F.lit(0)]
    before = W.partitionBy(*keyed).orderBy(here).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keyed)
    extra = [F.sum(t).over(whole).alias(f"{n}_all") for t, n in zip(tot, names, strict=True)] if grand else []
    offsets = totals.select(F.col(here).alias(there), *groups, *[F.sum(t).over(before).alias(o) for t, o in zip(tot, off, strict=True)], *extra)
    same = F.col(here) == F.col(there)
    for b, g in zip(by, groups, strict=True):
        same = same & ref(b).eqNullSafe(F.col(g))  # rows without a group are a group of their own
    joined = local.join(offsets, same)
    out = [(F.col(r) + F.coalesce(F.col(o), F.lit(0))).alias(n) for r, o, n in zip(run, off, names, strict=True)]
    return joined.select(*[ref(c) for c in df.columns], *out, *([f"{n}_all" for n in names] if grand else []))


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based position of each row in ``order`` (which must identify a row within its group)."""
    (one,) = free_names([*df.columns, name], "_one")
    return running_totals(df.withColumn(one, F.lit(1).cast("long")), order, {one: name}, by).drop(one)


def average_ranks(counts: DataFrame, value: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-averaged rank of each distinct value: adds ``rank``. ``counts`` holds one row per (by, value)."""
    (upto,) = free_names([*counts.columns, "rank"], "_upto")
    ranked = running_totals(counts, [value], {count: upto}, by)
    return ranked.withColumn("rank", F.col(upto) - (ref(count) - 1) / 2).drop(upto)
