"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Each source's share p of all tokens is raised to an exponent between 0 (equal weights) and 1 (proportional). A search
over the exponent, many sections at a time, meets a target entropy of the weights, or finds the flattest mix in which no
source is repeated more than ``max_repeats`` times within the budget. Every section is one small aggregate over the
table of sources, so the number of sources is not bounded by the driver.

A source with quota q of t tokens is read q / t times: whole epochs, each its own permutation, then part of one more.
For that part the documents are permuted by hash and cut into blocks; running sums over blocks, then inside the one
block where the budget ends, give a threshold of the hash. So the final pass decides every row by itself and no text is
shuffled.

Defined cases: a null text has no tokens; a null source is a source of its own; sources without tokens get no weight and
no copies; rows equal in id and text are taken or left together; an empty table gives an empty mix; a budget beyond
``max_repeats`` times all tokens is lowered to that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.functions.ordering import running_totals
from colonnade.llm.common import fresh
from colonnade.session import broadcast_if_small, materialise

SECTIONS = 16
ROUNDS = 9
BLOCK_DOCS = 4096
MIX_BLOCK_TOKENS = 1_000_000
MAX_REPEATS = 4.0
SEED = 11


def tokens(text_col: str = "text") -> Column:
    # One letter a word, then the letters alone: counting matches would make an object of every word of a text.
    letters = F.regexp_replace(F.regexp_replace(ref(text_col), r"\S+", "x"), r"\s+", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def source_key(source_col: str) -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), ref(source_col).cast("string")), F.lit("null"))


def order_key(epoch: Column, key: Column) -> Column:
    """Place of a row in the permutation of an epoch: 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch, key), 1)


def find_exponent(sources: DataFrame, budget: float, total: float, target_entropy: float | None, max_repeats: float) -> float:
    """Exponent at which the entropy of the weights (nats) meets its target, or the least one within ``max_repeats``.

    Entropy falls and the most repeated source rises less as the exponent grows, so either condition changes once.
    """
    shares = materialise(sources.where(F.col("t") > 0).select(F.log(F.col("t") / F.lit(float(total))).alias("lp")))
    low, high = 0.0, 1.0
    least = shares.agg(F.min("lp")).first()[0] or 0.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        sums = []
        for i, a in enumerate(grid):
            power = F.exp(F.col("lp") * F.lit(a))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.col("lp")).alias(f"l{i}")]
        row = shares.agg(*sums).first()

        def met(i: int) -> bool:
            z, mean = row[f"z{i}"], row[f"l{i}"]
            if z is None:
                return True
            if target_entropy is not None:
                return math.log(z) - grid[i] * mean / z <= target_entropy
            return budget / total * math.exp((grid[i] - 1) * least) / z <= max_repeats * (1 + 1e-12)

        first = next((i for i in range(SECTIONS + 1) if met(i)), SECTIONS)
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
    return high


def entropy_between(sources: DataFrame, total: float, flatness: float) -> float:
    """Entropy (nats) that lies ``flatness`` of the way from that of the sources' own shares (0) to that of equal weights (1)."""
    p = F.col("t") / F.lit(float(total))
    row = sources.where(F.col("t") > 0).agg(F.count("*").alias("n"), F.sum(-p * F.log(p)).alias("own")).first()
    own = row["own"] or 0.0
    return own + flatness * (math.log(max(row["n"], 1)) - own)


def plan(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float = MAX_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    flatness: float | None = None,
) -> DataFrame:
    """Per source key: tokens, docs, weight, quota, epochs, whole epochs, and the last hash of the part epoch (cut)."""
    rows = docs.select(
        source_key(source_col).alias("sid"), row_hash(id_col, text_col).alias("k"), tokens(text_col).alias("n")
    )
    rows = materialise(rows)
    sources = materialise(rows.groupBy("sid").agg(F.sum("n").alias("t"), F.count("*").alias("docs")))
    total = float(sources.agg(F.sum("t")).first()[0] or 0)
    if flatness is not None:
        target_entropy = entropy_between(sources, max(total, 1.0), flatness)
    wanted = min(float(budget if budget is not None else total), max_repeats * total)
    alpha = find_exponent(sources, wanted, max(total, 1.0), target_entropy, max_repeats)
    power = F.when(F.col("t") > 0, F.exp(F.log(F.col("t") / F.lit(max(total, 1.0))) * F.lit(alpha))).otherwise(0.0)
    z = float(sources.agg(F.sum(power)).first()[0] or 1.0) or 1.0
    quota = F.col("weight") * F.lit(wanted)
    made = sources.withColumn("weight", power / F.lit(z)).withColumn("quota", quota)
    made = made.withColumn("epochs", F.when(F.col("t") > 0, F.col("quota") / F.col("t")).otherwise(0.0))
    made = made.withColumn("whole", F.floor(F.col("epochs") + F.lit(1e-9)).cast("long"))
    made = made.withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("t"), F.lit(0.0)))
    made = made.withColumn("blocks", F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)).cast("long"))
    made = materialise(made.withColumn("exponent", F.lit(alpha)))
    # One row per source; sources may be many, so the side is measured before it is broadcast.
    placed = rows.join(broadcast_if_small(made.select("sid", "whole", "blocks", "rest")), "sid")
    h = order_key(F.col("whole"), F.col("k"))
    placed = placed.select("sid", "rest", "blocks", "n", h.alias("h")).withColumn("block", block_of(F.col("h"), F.col("blocks")))
    by_block = placed.groupBy("sid", "rest", "block").agg(F.sum("n").alias("n"))
    summed = running_totals(by_block, ["block"], {"n": "upto"}, ["sid"])
    # The first block that does not fit whole; blocks before it are taken.
    over = summed.where(F.col("upto") > F.col("rest")).groupBy("sid")
    edge = materialise(over.agg(F.min("block").alias("block"), F.min("upto").alias("upto"), F.min_by("n", "block").alias("edge_n")))
    edge = edge.select("sid", "block", (F.col("upto") - F.col("edge_n")).alias("before"))
    inside = placed.join(broadcast_if_small(edge), ["sid", "block"]).groupBy("sid", "rest", "before", "h").agg(F.sum("n").alias("n"))
    inside = running_totals(inside, ["h"], {"n": "upto"}, ["sid"])
    taken = inside.where(F.col("before") + F.col("upto") <= F.col("rest")).groupBy("sid").agg(F.max("h").alias("last"))
    cut = edge.join(taken, "sid", "left").select("sid", "block", "last")
    out = made.join(cut, "sid", "left")
    # No edge block: everything fits. No row taken inside the edge block: cut before it.
    none = F.floor(F.col("block") * (F.lit(2.0**63) / F.col("blocks"))).cast("long") - 1
    cut_at = F.when(F.col("block").isNull(), F.lit(2**63 - 1)).otherwise(F.coalesce("last", none))
    return materialise(out.withColumn("cut", F.when(F.col("rest") > 0, cut_at).otherwise(F.lit(-1))).drop("block", "last"))


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), ref(id_col).cast("string"), ref(text_col))


def block_of(h: Column, blocks: Column) -> Column:
    """Block of a place in the permutation; blocks are equal ranges of the hash."""
    return F.least(F.floor(h / (F.lit(2.0**63) / blocks)).cast("long"), blocks - 1)


def mix(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float = MAX_REPEATS,
    columns: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    flatness: float | None = None,
) -> DataFrame:
    """The mixture: ``columns`` of ``docs`` (default all) once per copy, plus epoch, mix_tokens, mix_weight, mix_position,
    mix_block.

    ``flatness`` sets the target entropy between the sources' own shares (0) and equal weights (1), whatever their sizes are.
    mix_position (0 to 1) orders the mixture; each source is spread evenly over it. Blocks hold about a million tokens.
    """
    sources = plan(docs, budget, target_entropy, max_repeats, id_col, text_col, source_col, flatness)
    spent = float(sources.agg(F.sum("quota")).first()[0] or 0.0)
    mix_blocks = max(1, math.ceil(spent / MIX_BLOCK_TOKENS))
    small = broadcast_if_small(sources.select(*[F.col(c).alias(f"_mix_{c}") for c in ("sid", "weight", "epochs", "whole", "cut")]))
    keep = [ref(c) for c in (columns or docs.columns)]
    own = {n: fresh(docs, n) for n in ("_mix_k", "_mix_n")}
    rows = docs.withColumns({own["_mix_k"]: row_hash(id_col, text_col), own["_mix_n"]: tokens(text_col)})
    rows = rows.join(small, source_key(source_col) == F.col("_mix_sid"))
    key, whole = ref(own["_mix_k"]), F.col("_mix_whole")
    copies = whole + (order_key(whole, key) <= F.col("_mix_cut")).cast("long")
    rows = rows.withColumn("_mix_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array())))
    u = order_key(F.col("_mix_epoch"), key) / F.lit(2.0**63)
    # In the part epoch the places up to the cut fill what is left of the source's range.
    last = F.col("_mix_epoch") == whole
    share = F.when(last, u / ((F.col("_mix_cut") + 1) / F.lit(2.0**63)) * (F.col("_mix_epochs") - whole)).otherwise(u)
    position = F.least((F.col("_mix_epoch") + share) / F.col("_mix_epochs"), F.lit(1.0 - 1e-12))
    names = {n: fresh(docs, n) for n in ("epoch", "mix_tokens", "mix_weight", "mix_position", "mix_block")}
    return rows.select(
        *keep,
        F.col("_mix_epoch").alias(names["epoch"]),
        ref(own["_mix_n"]).alias(names["mix_tokens"]),
        F.col("_mix_weight").alias(names["mix_weight"]),
        position.alias(names["mix_position"]),
        F.floor(position * mix_blocks).cast("long").alias(names["mix_block"]),
    )
