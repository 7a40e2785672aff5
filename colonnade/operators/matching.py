"""Matching of treated and control units: nearest score, exact keys, both, and Mahalanobis distance.

Units are rows (id bigint, treated 0/1, ps double, optional stratum). Results are pairs (treated_id, control_id, distance).
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.functions.neighbors import cut_of, knn_join, leaf_of
from colonnade.functions.ordering import positions, running_totals
from colonnade.session import keep, materialise

ONE_STRATUM = "all"


def units_of(df: DataFrame, unit_id: str, treatment: str, score: Column | str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Normalise to (id, treated, ps, stratum); the stratum joins the exact-match keys by a bar."""
    ps = F.lit(0.0) if score is None else (ref(score) if isinstance(score, str) else score)
    stratum = F.concat_ws("|", *[F.coalesce(ref(k).cast("string"), F.lit("nan")) for k in keys]) if keys else F.lit(ONE_STRATUM)
    return df.select(ref(unit_id).cast("long").alias("id"), ref(treatment).cast("int").alias("treated"), ps.cast("double").alias("ps"), stratum.alias("stratum"))


def match_with_replacement(units: DataFrame, k: int = 1, caliper: float | None = None) -> DataFrame:
    """The k nearest controls by score for every treated unit, controls reusable, within the caliper if given.

    Controls are numbered in score order; the candidates of a treated unit are the k numbers before and after it, so
    pairs come from equi-joins on numbers, never from a band of scores.
    """
    line = units.withColumn("_c", (1 - F.col("treated")).cast("long"))
    # Controls sort before treated units of the same score, so equal scores count as "before".
    run = keep(running_totals(line, ["ps", "treated", "id"], {"_c": "_no"}, ["stratum"]))
    controls = run.where("treated = 0").select("stratum", F.col("_no").alias("_slot"), F.col("id").alias("control_id"), F.col("ps").alias("_cps"))
    wanted = run.where("treated = 1").select(
        "stratum", F.col("id").alias("treated_id"), "ps", F.explode(F.sequence(F.col("_no") - (k - 1), F.col("_no") + k)).alias("_slot")
    )
    pairs = wanted.join(controls, ["stratum", "_slot"]).withColumn("distance", F.abs(F.col("ps") - F.col("_cps")))
    if caliper is not None:
        pairs = pairs.where(F.col("distance") <= caliper)
    best = W.partitionBy("treated_id").orderBy("distance", "control_id")  # at most 2k rows each
    return pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("treated_id", "control_id", "distance")


RANGE_GROUPS = 20_000
UNIT_CHUNK = 10_000


def _sweep(k: int, caliper: float | None):
    """Greedy pass over one range: treated score groups from the highest score, each taking the nearest free controls.

    Works on distinct scores with counts. Reports whether an unseen control beyond the visible edge could have been
    nearer, in which case the range is tried again with a wider view.
    """
    limit = float("inf") if caliper is None else caliper

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cs = pdf[pdf["side"] == 0]
        pos, ps, free = cs["pos"].tolist(), cs["ps"].tolist(), cs["amount"].tolist()
        n = len(pos)
        # Path-compressed links to the nearest index with free controls; up is shifted by one: slot i+1 stands for index i.
        up, down = list(range(n + 1)), list(range(n + 1))

        def find(links, i):
            root = i
            while links[root] != root:
                root = links[root]
            while links[i] != root:
                links[i], i = root, links[i]
            return root

        for i in range(n):
            if free[i] <= 0:
                up[i + 1], down[i] = i, i + 1
        edges = pdf[pdf["side"] == 2]
        above = edges["ps"].max() if len(edges) else float("nan")
        below = edges["ps"].min() if len(edges) else float("nan")
        has_above = bool(len(edges[edges["amount"] == 1]))
        has_below = bool(len(edges[edges["amount"] == 2]))
        if has_above:
            above = edges[edges["amount"] == 1]["ps"].iloc[0]
        if has_below:
            below = edges[edges["amount"] == 2]["ps"].iloc[0]
        rows, narrow = [], False
        ts = pdf[pdf["side"] == 1]
        for tpos, tps, count in zip(ts["pos"], ts["ps"], ts["amount"], strict=True):
            need, start = int(count) * k, 0
            at = bisect.bisect_right(pos, tpos)  # controls with pos <= tpos have a score at least as high
            while need > 0:
                hi, lo = find(up, at) - 1, find(down, at)
                d_hi = ps[hi] - tps if hi >= 0 else float("inf")
                d_lo = tps - ps[lo] if lo < n else float("inf")
                edge_hi = above - tps if hi < 0 and has_above else float("inf")
                edge_lo = tps - below if lo >= n and has_below else float("inf")
                d = min(d_hi, d_lo)
                # Unseen controls on a used-up side lie at or beyond the edge; they matter when not clearly farther.
                if min(edge_hi, edge_lo) <= min(d, limit):
                    narrow = True
                    if d == float("inf"):
                        break
                if d > limit or d == float("inf"):
                    break
                c = hi if d_hi <= d_lo else lo
                take = min(need, free[c])
                rows.append((int(tpos), int(pos[c]), start, take, d, False))
                free[c] -= take
                start += take
                need -= take
                if free[c] == 0:
                    up[c + 1], down[c] = c, c + 1
        if narrow:
            rows.append((-1, -1, 0, 0, 0.0, True))
        out = pd.DataFrame(rows, columns=["tpos", "cpos", "start", "amount", "distance", "narrow"])
        out.insert(0, "range", key[1])
        out.insert(0, "stratum", key[0])
        return out

    return run


def match_without_replacement(
    units: DataFrame, k: int = 1, caliper: float | None = None, range_groups: int = RANGE_GROUPS
) -> DataFrame:
    """Greedy nearest-score matching, every control used at most once, treated units from the highest score down.

    Equal scores are folded to counts, and the score line of each stratum is cut into ranges of ``range_groups``
    distinct scores. All ranges sweep in parallel; what the higher ranges take from a range's visible controls enters
    its next sweep, and a range whose view was too narrow sees twice as many neighbours. A range depends on higher
    ranges only, so the repeated sweeps settle on exactly the sequential result, after at most as many rounds as there
    are ranges (mostly a few). Ties of distance take the higher score, ties of score the smaller id.
    """
    counts = units.groupBy("stratum", "ps").agg(
        F.sum("treated").cast("long").alias("nt"), F.sum(1 - F.col("treated")).cast("long").alias("nc")
    ).withColumn("_one", F.lit(1).cast("long"))
    groups = running_totals(counts, ["-ps"], {"_one": "pos"}, ["stratum"])
    groups = materialise(groups.drop("_one").withColumn("range", F.floor((F.col("pos") - 1) / range_groups).cast("long")))
    limits = groups.groupBy("stratum").agg(F.max("range").alias("_top"))
    reach = groups.where("nt > 0").select("stratum", "range").distinct().join(limits, "stratum").withColumn("w", F.lit(1).cast("long"))
    reach = materialise(reach)
    treated = groups.where("nt > 0").select("stratum", "range", F.lit(1).alias("side"), "pos", "ps", F.col("nt").alias("amount"))
    usage_schema = "stratum string, range bigint, tpos bigint, cpos bigint, start bigint, amount bigint, distance double, narrow boolean"
    usage, mark = None, None
    single = not limits.where("_top > 0").take(1)
    while True:
        views = reach.select(
            "stratum", F.col("range").alias("target"), "w", "_top",
            F.explode(F.sequence(F.greatest(F.col("range") - F.col("w"), F.lit(0)), F.least(F.col("range") + F.col("w"), F.col("_top")))).alias("range"),
        )
        seen = groups.join(views, ["stratum", "range"])
        free = seen.where("nc > 0").select("stratum", "target", "pos", "ps", "nc")
        if usage is not None:
            taken = usage.where("NOT narrow").select("stratum", F.col("range").alias("_by"), F.col("cpos").alias("pos"), F.col("amount").alias("_a"))
            taken = taken.groupBy("stratum", "_by", "pos").agg(F.sum("_a").alias("_a"))
            higher = free.join(taken, ["stratum", "pos"]).where(F.col("_by") < F.col("target"))
            higher = higher.groupBy("stratum", "target", "pos").agg(F.sum("_a").alias("_used"))
            free = free.join(higher, ["stratum", "target", "pos"], "left").withColumn("nc", F.col("nc") - F.coalesce("_used", F.lit(0)))
        # The scores at both ends of the view, marked 1 (more above) and 2 (more below) where the line goes on.
        ends = seen.groupBy("stratum", "target").agg(
            F.max(F.struct("ps", (F.col("range") > 0).alias("more"))).alias("a"),
            F.min(F.struct("ps", (F.col("range") < F.col("_top")).alias("more"))).alias("b"),
        )
        edges = ends.select("stratum", F.col("target").alias("range"), F.lit(2).alias("side"), F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("pos"), F.col("a.ps").alias("ps"), F.when(F.col("a.more"), 1).otherwise(0).cast("long").alias("amount")),
            F.struct(F.lit(0).cast("long").alias("pos"), F.col("b.ps").alias("ps"), F.when(F.col("b.more"), 2).otherwise(0).cast("long").alias("amount")),
        )).alias("_e")).select("stratum", "range", "side", "_e.*")
        rows = treated.unionByName(
            free.select("stratum", F.col("target").alias("range"), F.lit(0).alias("side"), "pos", "ps", F.col("nc").alias("amount"))
        ).unionByName(edges)
        usage = materialise(rows.groupBy("stratum", "range").applyInPandas(_sweep(k, caliper), usage_schema))
        state = usage.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("stratum", "tpos", "cpos", "start", "amount").cast("decimal(38,0)")).alias("h"),
            F.count_if("narrow").alias("narrow"),
        ).first()
        now = (state["n"], state["h"])
        if state["narrow"]:
            wider = usage.where("narrow").select("stratum", "range", F.lit(True).alias("_wide"))
            reach = materialise(reach.join(wider, ["stratum", "range"], "left").withColumn(
                "w", F.when(F.col("_wide"), F.col("w") * 2).otherwise(F.col("w"))).drop("_wide"))
        elif single or now == mark:
            break
        mark = now
    return _expand_pairs(units, groups, usage, k)


def _expand_pairs(units: DataFrame, groups: DataFrame, usage: DataFrame, k: int) -> DataFrame:
    """From amounts between score groups to pairs of ids: units of a group are numbered by id and used in that order."""
    numbered = positions(units.select("stratum", "ps", "treated", "id"), ["id"], ["stratum", "ps", "treated"], name="no")
    spots = groups.select("stratum", "ps", "pos")
    used = usage.where("NOT narrow")
    # A control group serves its treated groups from the highest score down.
    used = running_totals(used.drop("narrow", "range"), ["tpos", "start"], {"amount": "_end"}, ["stratum", "cpos"])
    chunks = used.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("amount") - 1, F.lit(UNIT_CHUNK).cast("long"))).alias("_lo")
    )
    unit = F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + UNIT_CHUNK, F.col("amount")) - 1)).alias("_u")
    ties = chunks.select("stratum", "tpos", "cpos", "start", "amount", "_end", "distance", unit)
    ties = ties.select(
        "stratum", "tpos", "cpos", "distance", (F.floor((F.col("start") + F.col("_u")) / k) + 1).alias("_tno"),
        (F.col("_end") - F.col("amount") + F.col("_u") + 1).alias("_cno"),
    )
    placed = keep(numbered.join(spots, ["stratum", "ps"]))
    t = placed.where("treated = 1").select("stratum", F.col("pos").alias("tpos"), F.col("no").alias("_tno"), F.col("id").alias("treated_id"))
    c = placed.where("treated = 0").select("stratum", F.col("pos").alias("cpos"), F.col("no").alias("_cno"), F.col("id").alias("control_id"))
    return ties.join(t, ["stratum", "tpos", "_tno"]).join(c, ["stratum", "cpos", "_cno"]).select("treated_id", "control_id", "distance")


def match_exact(units: DataFrame) -> DataFrame:
    """Within each key the n-th treated unit (by id) gets the n-th control; units left over stay unmatched."""
    no = keep(positions(units.select("stratum", "treated", "id"), ["id"], ["stratum", "treated"], name="no"))
    t = no.where("treated = 1").select("stratum", "no", F.col("id").alias("treated_id"))
    c = no.where("treated = 0").select("stratum", "no", F.col("id").alias("control_id"))
    return t.join(c, ["stratum", "no"]).select("treated_id", "control_id", F.lit(0.0).alias("distance"))


def whiten(df: DataFrame, cols: Sequence[str]) -> tuple[Column, np.ndarray]:
    """Array column in which Euclidean distance is the Mahalanobis distance over ``cols``; one covariance pass."""
    p = len(cols)
    aggs = [F.covar_samp(ref(cols[i]).cast("double"), ref(cols[j]).cast("double")).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    r = df.agg(*aggs).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    values, vectors = np.linalg.eigh(np.linalg.pinv(cov))
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T
    parts = []
    for i in range(p):
        out = F.lit(0.0)
        for j in range(p):
            out = out + F.lit(float(root[i, j])) * ref(cols[j]).cast("double")
        parts.append(out)
    return F.array(*parts), root


def mahalanobis_caliper(caliper: float | None) -> float | None:
    """Score caliper on the Mahalanobis scale: ten times as wide, at least one."""
    return None if caliper is None else max(caliper * 10, 1.0)


# Nearest places of controls that a place of treated units asks for first, and by how much a list grows that ran out.
FIRST_CANDIDATES = 8
MORE_CANDIDATES = 4
# Treated units that one task goes through, about.
REGION_UNITS = 20_000


def match_mahalanobis(
    df: DataFrame, unit_id: str, treatment: str, cols: Sequence[str], caliper: float | None = None, with_replacement: bool = True
) -> DataFrame:
    """Nearest control by Mahalanobis distance within the (already scaled) caliper; treated units in id order.

    Without replacement every control is used at most once, see ``_match_once``.
    """
    vec, _ = whiten(df, cols)
    rows = keep(df.select(ref(unit_id).cast("long").alias("id"), ref(treatment).cast("int").alias("treated"), vec.alias("vec")))
    if not with_replacement:
        return _match_once(rows, caliper)
    refs = rows.where("treated = 0").select(F.col("id").alias("rid"), "vec")
    near = knn_join(rows.where("treated = 1").select(F.col("id").alias("qid"), "vec"), refs, 1)
    near = near if caliper is None else near.where(F.col("distance") <= caliper)
    return near.select(F.col("qid").alias("treated_id"), F.col("rid").alias("control_id"), "distance")


TAKES = "region int, place bigint, qid bigint, spot bigint, rid bigint, distance double"


def _take(key, places: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """The treated units of one region in id order, each taking the nearest control that no smaller id has taken.

    ``seen`` holds the spots of the lists with their controls, and the ids of other regions that take one there. The n-th id
    at a spot gets its n-th control. A unit whose list ran out although more controls may be near reports no control.
    """
    spots = seen[seen["rids"].notna()]
    rids = {s: r.tolist() for s, r in zip(spots["spot"], spots["rids"], strict=True)}
    given = seen[seen["rids"].isna()]
    others = {s: t.tolist() for s, t in zip(given["spot"], given["takers"], strict=True)}
    names, whole, lists, ends = places["place"].tolist(), places["whole"].tolist(), [], []
    for s, d, all_of in zip(places["spots"], places["distances"], places["whole"], strict=True):
        lists.append((s.tolist(), d.tolist()))
        # Spots unseen may be as near as the last ones of a list that was cut off.
        ends.append(len(d) if all_of else int(np.searchsorted(d, d[-1])))
    units = sorted((q, i) for i, ids in enumerate(places["qids"]) for q in ids.tolist())
    at, own, passed, rows = [0] * len(lists), dict.fromkeys(rids, 0), dict.fromkeys(others, 0), []
    for qid, i in units:
        near, away = lists[i]
        end, best, j = ends[i], None, at[i]
        while j < end and (best is None or away[j] == best[0]):
            spot = near[j]
            n = own[spot]
            if spot in others:
                ids = others[spot]
                while passed[spot] < len(ids) and ids[passed[spot]] < qid:
                    passed[spot] += 1
                n += passed[spot]
            if n < len(rids[spot]):
                found = (away[j], rids[spot][n], spot)
                best = found if best is None else min(best, found)
            elif j == at[i]:  # later ids find this spot full as well
                at[i] += 1
            j += 1
        if best:
            own[best[2]] += 1
            rows.append((names[i], qid, best[2], best[1], best[0]))
        elif not whole[i]:
            rows.append((names[i], qid, None, None, None))
    out = pd.DataFrame(rows, columns=["place", "qid", "spot", "rid", "distance"]).astype({"spot": "Int64", "rid": "Int64", "distance": "float64"})
    out.insert(0, "region", key[0])
    return out


def _match_once(rows: DataFrame, caliper: float | None) -> DataFrame:
    """Pairs of (id, treated, vec) when treated units in id order take the nearest control still free.

    Units at one point share a place, controls at one point a spot, and a place has the list of its nearest spots. The
    places are dealt to regions that lie together. All regions go through their units in parallel; the ids that took a control
    at a common spot in other regions enter the next round, and only how many they are matters. What a unit gets depends on smaller ids only, so the rounds settle
    on exactly the sequential result. Lists grow only for places that exhaust theirs.
    """
    # An id at several points counts once.
    known = keep(rows.where(F.col("id").isNotNull()).groupBy("treated", "id").agg(F.min("vec").alias("vec")))
    points = lambda t, name: known.where(F.col("treated") == t).groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias(name))
    spots = materialise(points(0, "rids").withColumn("spot", F.monotonically_increasing_id()))
    places = materialise(points(1, "qids").withColumn("place", F.monotonically_increasing_id()))
    n_spots, n_places = spots.count(), places.count()
    if not n_places or not n_spots:
        return rows.sparkSession.createDataFrame([], "treated_id bigint, control_id bigint, distance double")
    units = places.agg(F.sum(F.size("qids"))).first()[0]
    region = leaf_of(cut_of(places, n_places, max(1, int(REGION_UNITS * n_places / units))))
    places = keep(places.withColumn("region", region("vec")))

    def lists_of(asked: DataFrame, k: int) -> DataFrame:
        near = knn_join(asked.select(F.col("place").alias("qid"), "vec"), spots.select(F.col("spot").alias("rid"), "vec"), k)
        near = near if caliper is None else near.where(F.col("distance") <= caliper)
        near = near.groupBy(F.col("qid").alias("place")).agg(F.array_sort(F.collect_list(F.struct("distance", "rid"))).alias("_l"))
        whole = (F.size("_l") < k) | F.lit(k >= n_spots)
        return asked.select("region", "place", "qids").join(near, "place").select(
            "region", "place", "qids", F.col("_l.rid").alias("spots"), F.col("_l.distance").alias("distances"), whole.alias("whole"))

    k, lists, mark = FIRST_CANDIDATES, materialise(lists_of(places, FIRST_CANDIDATES)), None
    while True:
        if mark is None:
            seen = lists.select("region", F.explode("spots").alias("spot")).distinct().join(spots.select("spot", "rids"), "spot")
            seen = materialise(seen)
            shared = seen.groupBy("spot").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("spot")
            contested = keep(seen.join(shared, "spot").select(F.col("region").alias("_to"), "spot"))
            alone, takes = not contested.take(1), None
        known_of = seen.select(F.col("region").alias("_to"), "spot", "rids")
        if takes is not None:
            given = takes.where(F.col("spot").isNotNull()).join(contested, "spot").where(F.col("_to") != F.col("region"))
            given = given.groupBy("_to", "spot").agg(F.sort_array(F.collect_list("qid")).alias("takers"))
            known_of = known_of.unionByName(given, allowMissingColumns=True)
        else:
            known_of = known_of.withColumn("takers", F.lit(None).cast("array<long>"))
        takes = materialise(lists.groupBy("region").cogroup(known_of.groupBy("_to")).applyInPandas(_take, TAKES))
        state = takes.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("qid", "spot").cast("decimal(38,0)")).alias("h"), F.count_if(F.col("rid").isNull()).alias("short")).first()
        now = (state["n"], state["h"])
        settled, mark = alone or now == mark, now
        if settled and not state["short"]:
            return takes.select(F.col("qid").alias("treated_id"), F.col("rid").alias("control_id"), "distance")
        if settled:
            # Only when the regions agree is a list known to be too short.
            k *= MORE_CANDIDATES
            short = keep(takes.where(F.col("rid").isNull()).select("place").distinct())
            lists = materialise(lists.join(short, "place", "left_anti").unionByName(lists_of(places.join(short, "place"), k)))
            mark = None


def matched_rows(df: DataFrame, unit_id: str, pairs: DataFrame) -> DataFrame:
    """The matched table: the treated row once per pair, then its control, both carrying ``_pair_id``."""
    sides = [
        pairs.select(F.col(c).alias("_unit"), F.col("treated_id").alias("_pair_id")) for c in ("treated_id", "control_id")
    ]
    return sides[0].unionAll(sides[1]).join(df, F.col("_unit") == ref(unit_id).cast("long")).drop("_unit")


def match_summary(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched pairs, matched and unmatched treated units and the match rate."""
    t = units.agg(F.sum("treated").cast("long").alias("treated_units"))
    m = pairs.agg(F.count("*").alias("pairs"), F.count_distinct("treated_id").alias("matched_treated"))
    return m.join(F.broadcast(t)).select(
        "pairs", "matched_treated", (F.col("treated_units") - F.col("matched_treated")).alias("unmatched_treated"),
        F.try_divide(F.col("pairs") * 100.0, F.col("treated_units")).alias("match_rate"),
    )
