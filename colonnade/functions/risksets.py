"""Partial-likelihood sums over risk sets with fixed ranges: rows are put in order once, every evaluation only reads them.

The rows lie in ranges of (stratum, time from late to early), equal times spread over several ranges where they are many. An
evaluation reads the ranges twice, without a shuffle. The first reading brings one row per range to the driver: the sums
of its first and last run of equal times, and what lies between them. From these the driver knows what is at risk when each
range starts, and decides the runs that touch a range's edge itself. The second reading decides the runs inside. The driver
holds a few numbers per range and coefficient pair, whatever the number of rows, times or strata.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.session import materialise

# Terms of a tie sum taken one by one; the rest goes through Euler-Maclaurin, so a tie of any size costs the same.
TIE_TERMS = 64
# Numbers of a block of rows with their products, about.
BLOCK_NUMBERS = 4_000_000


def tie_sums(a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over l = 0..d-1 of log(a-l), 1/(a-l) and 1/(a-l)^2."""
    m = np.maximum(d - TIE_TERMS, 0)
    b = a - m
    far = m > 0
    logs, ones, squares = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    x, y, k = a[far], b[far], m[far]
    logs[far] = x * np.log(x) - y * np.log(y) - k - (np.log(y) - np.log(x)) / 2 + (1 / x - 1 / y) / 12 - (2 / x**3 - 2 / y**3) / 720
    ones[far] = -np.log1p(-k / x) - (1 / y - 1 / x) / 2 + (1 / y**2 - 1 / x**2) / 12 - (6 / y**4 - 6 / x**4) / 720
    squares[far] = (1 / y - 1 / x) - (1 / y**2 - 1 / x**2) / 2 + (2 / y**3 - 2 / x**3) / 12 - (24 / y**5 - 24 / x**5) / 720
    for j in range(int((d - m).max(initial=0))):
        on = m + j < d
        left = b[on] - j
        logs[on] += np.log(left)
        ones[on] += 1 / left
        squares[on] += 1 / left**2
    return logs, ones, squares


@dataclass(frozen=True)
class Layout:
    """Where the sums of a run of equal times stand in its vector, for ``p`` predictors."""

    p: int

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.triu_indices(self.p)

    @property
    def risk(self) -> int:
        """Sums over everybody: weight, weighted predictors, weighted products."""
        return 1 + self.p + len(self.pairs[0])

    @property
    def width(self) -> int:
        """Then over events: number, log weight, predictors, and the weighted sums once more."""
        return 2 * self.risk + 2 + self.p

    def rows(self, x: np.ndarray, e: np.ndarray, beta: np.ndarray) -> np.ndarray:
        i, j = self.pairs
        log_w = x @ beta
        w = np.exp(log_w)[:, None]
        all_of = np.hstack([w, w * x, w * x[:, i] * x[:, j]])
        event = e[:, None]
        return np.hstack([all_of, event, event * log_w[:, None], event * x, event * all_of])

    def decide(self, run: np.ndarray, at_risk: np.ndarray) -> np.ndarray:
        """Efron's contributions of runs (rows of sums) with what is at risk (theirs included): log-likelihood, gradient, information."""
        p, r = self.p, self.risk
        i, j = self.pairs
        died = run[:, r] > 0
        run, at_risk = run[died], at_risk[died]
        d, log_events, z, of_events = run[:, r], run[:, r + 1], run[:, r + 2 : r + 2 + p], run[:, r + 2 + p :]
        d0, d1, d2 = of_events[:, 0], of_events[:, 1 : 1 + p], of_events[:, 1 + p :]
        r0, r1, r2 = at_risk[:, 0], at_risk[:, 1 : 1 + p], at_risk[:, 1 + p :]
        logs, ones, squares = tie_sums(d * r0 / d0, d)
        unit = d / d0
        k1, k2 = (ones * unit)[:, None], (squares * unit**2)[:, None]
        u = d1 / d0[:, None]
        v = r1 - u * r0[:, None]
        d, share = d[:, None], d2 / d0[:, None]
        value = (log_events - logs - d[:, 0] * np.log(1 / unit))[:, None]
        gradient = z - d * u - v * k1
        first = d * share + (r2 - share * r0[:, None]) * k1
        outer = d * u[:, i] * u[:, j] + (u[:, i] * v[:, j] + v[:, i] * u[:, j]) * k1 + v[:, i] * v[:, j] * k2
        return np.hstack([value, gradient, first - outer]).sum(axis=0)


def runs_of(batches: Iterator[pd.DataFrame], columns: Sequence[str], beta: np.ndarray) -> Iterator[tuple[list, np.ndarray]]:
    """Runs of equal (stratum, time) of one range in order: their keys and sums; a run may go on over several batches."""
    layout = Layout(len(columns))
    open_key, open_sums = None, None
    for pdf in batches:
        step = max(1, BLOCK_NUMBERS // layout.width)
        for lo in range(0, len(pdf), step):
            part = pdf.iloc[lo : lo + step]
            keys = list(zip(part["_s"].tolist(), part["t"].tolist(), strict=True))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
            sums = np.add.reduceat(layout.rows(part[list(columns)].to_numpy(float), part["e"].to_numpy(float), beta), starts, axis=0)
            keys = [keys[k] for k in starts]
            if open_key is not None:
                if open_key == keys[0]:
                    sums[0] += open_sums
                else:
                    keys, sums = [open_key, *keys], np.vstack([open_sums, sums])
            open_key, open_sums = keys[-1], sums[-1]
            if len(keys) > 1:
                yield keys[:-1], sums[:-1]
    if open_key is not None:
        yield [open_key], open_sums[None]


def inner_runs(runs: Iterator[tuple[list, np.ndarray]]) -> Iterator[tuple[list, np.ndarray]]:
    """All runs of a range but its first and last."""
    skipped, held_keys, held = False, None, None
    for keys, sums in runs:
        if not skipped:
            keys, sums, skipped = keys[1:], sums[1:], True
        if held is not None:
            keys, sums = held_keys + keys, np.vstack([held, sums])
        if keys:
            if len(keys) > 1:
                yield keys[:-1], sums[:-1]
            held_keys, held = keys[-1:], sums[-1:]


def by_stratum(keys: list, sums: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    if not keys:
        return
    edges = [0, *(k for k in range(1, len(keys)) if keys[k][0] != keys[k - 1][0]), len(keys)]
    for lo, hi in zip(edges, edges[1:]):
        yield keys[lo][0], sums[lo:hi]


class RiskRows:
    """Rows of ``frame`` (t, e, predictors and the columns of ``by``) in fixed ranges."""

    def __init__(self, frame: DataFrame, columns: Sequence[str], by: Sequence[str]):
        self.columns, self.layout = list(columns), Layout(len(columns))
        stratum = F.to_json(F.struct(*by)) if by else F.lit("")
        rows = frame.select(stratum.alias("_s"), F.col("t").cast("double").alias("t"), F.col("e").cast("double").alias("e"), *columns)
        # The predictors stand last in the order so that a very frequent time is spread over ranges.
        order = [F.col("_s"), F.col("t").desc(), F.xxhash64("e", *columns)]
        ranged = rows.repartitionByRange(*order).sortWithinPartitions("_s", F.col("t").desc())
        self.rows = materialise(ranged.withColumn("_part", F.spark_partition_id()))

    def evaluate(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and information at ``beta``."""
        columns, layout, p = self.columns, self.layout, self.layout.p
        r = layout.risk

        def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part: list[int] = []

            def noted():
                for pdf in batches:
                    part[:] = part or [int(pdf["_part"].iloc[0])]
                    yield pdf

            first = last = None
            count, after_first, before_last, stratum = 0, np.zeros(r), np.zeros(r), None
            for keys, sums in runs_of(noted(), columns, beta):
                count += len(keys)
                if first is None:
                    first = (keys[0], sums[0])
                    keys, sums = keys[1:], sums[1:]
                if last is not None:  # it lies inside after all
                    keys, sums = [last[0], *keys], np.vstack([last[1], sums])
                for s, block in by_stratum(keys[:-1], sums[:-1]):
                    total = block[:, :r].sum(axis=0)
                    if s == first[0][0]:
                        after_first = after_first + total
                    before_last = before_last + total if s == stratum else total
                    stratum = s
                if keys:
                    last = (keys[-1], sums[-1])
            last = last or first
            if first is not None:
                yield pd.DataFrame(
                    {
                        "part": part, "runs": [count], "s0": [first[0][0]], "t0": [first[0][1]], "first": [first[1]], "s1": [last[0][0]],
                        "t1": [last[0][1]], "last": [last[1]], "after": [after_first], "before": [before_last if stratum == last[0][0] else np.zeros(r)],
                    }
                )

        schema = "part int, runs long, s0 string, t0 double, first array<double>, s1 string, t1 double, last array<double>, after array<double>, before array<double>"
        found = sorted(self.rows.mapInPandas(edges, schema).collect(), key=lambda x: x["part"])
        total = np.zeros(r)
        at_risk, stratum = np.zeros(r), None
        open_key, open_run = None, None
        offsets: dict[int, tuple[str, np.ndarray]] = {}

        def close():
            nonlocal at_risk, stratum, total
            if open_key is None:
                return
            at_risk = (at_risk if stratum == open_key[0] else 0) + open_run[:r]
            stratum = open_key[0]
            total = total + layout.decide(open_run[None], at_risk[None])

        for row in found:
            first, key = np.array(row["first"]), (row["s0"], row["t0"])
            if key == open_key:
                open_run = open_run + first
            else:
                close()
                open_key, open_run = key, first
            if row["runs"] > 1:
                close()
                offsets[row["part"]] = (stratum, at_risk)
                inside = np.array(row["after"]) if row["s1"] == row["s0"] else np.array(row["before"])
                at_risk = at_risk + inside if row["s1"] == stratum else inside
                stratum, open_key, open_run = row["s1"], (row["s1"], row["t1"]), np.array(row["last"])
        close()
        shared = self.rows.sparkSession.sparkContext.broadcast(offsets)

        def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part: list[int] = []

            def noted():
                for pdf in batches:
                    part[:] = part or [int(pdf["_part"].iloc[0])]
                    yield pdf

            out, held = np.zeros(1 + p + len(layout.pairs[0])), None
            for keys, sums in inner_runs(runs_of(noted(), columns, beta)):
                if held is None:
                    held = shared.value[part[0]]
                for s, block in by_stratum(keys, sums):
                    start = held[1] if held[0] == s else np.zeros(r)
                    upto = start + np.cumsum(block[:, :r], axis=0)
                    out = out + layout.decide(block, upto)
                    held = (s, upto[-1])
            if part:
                yield pd.DataFrame({"sums": [out]})

        for row in self.rows.mapInPandas(inside, "sums array<double>").collect():
            total = total + np.array(row["sums"])
        shared.unpersist()
        info = np.zeros((p, p))
        info[layout.pairs] = total[1 + p :]
        return float(total[0]), total[1 : 1 + p], info + np.triu(info, 1).T
