"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three fixed patterns give the base spans of every whole text. A fourth pattern adds long mixed tokens as candidates. The
value of every candidate is hashed; per hash the corpus is asked how many owners and how many repositories hold it. A
value held by several owners or many repositories is a copied example; one held by few is a live-looking credential.
Added candidates become spans only when they look live; base spans always stay.

Positions come from the text between matches: a split by the pattern and the matches themselves alternate, so running
sums of their lengths (code points) are the offsets. The sums run over one document's matches of one kind.

Defined cases: a null text counts as empty; a document without matches has zero counts and the digest of the empty
string; a null owner is one owner, a null repository one repository; repeated rows (same id and text) share their
spans, and every owner and repository among them counts; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.context import ref
from colonnade.llm.common import row_key, settle
from colonnade.session import materialise

# Fixed patterns: (kind, pattern, group that holds the value, least length of the value, least length of the match).
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, 0),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 0, 24),  # a whole run either way, so the least length can stand in the pattern
]
# Long tokens that mix letters and digits; those that overlap a base span of the document are left to it.
ADDED = ("bare", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 0, 20)
KINDS = [k[0] for k in [*BASE, ADDED]]
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10


def _matches(kind: str, pattern: str, group: int) -> Column:
    """All matches of one pattern with the length of the text before each, in order."""
    text, p = F.col("text"), F.lit(pattern)
    found = F.when(text.rlike(pattern), F.regexp_extract_all(text, p, F.lit(0)))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value"))
    return F.when(
        found.isNotNull(),
        F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), z["gap"].alias("gap"),
                F.length(z["match"]).alias("width"), z["value"].alias("value"),
            ),
        ),
    ).otherwise(F.array())


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate of each distinct row: key_a, key_b, kind (index in KINDS), start, end, hash of the value."""
    a, b = row_key(id_col, text_col)
    rows = docs.select(a.alias("key_a"), b.alias("key_b"), ref(text_col).alias("text"))
    specs = [*BASE, ADDED]
    some = F.lit(False)
    for _, pattern, *_ in specs:
        some = some | F.col("text").rlike(pattern)
    rows = rows.where(some).dropDuplicates(["key_a", "key_b"])
    found = F.explode(F.concat(*[_matches(k, p, g) for k, p, g, *_ in specs])).alias("m")
    rows = rows.select("key_a", "key_b", found).select("key_a", "key_b", "m.*")
    rows = rows.where(F.col("width").isNotNull())
    before = W.partitionBy("key_a", "key_b", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("width")).cast("long")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("width"))
    fits = F.lit(False)
    for i, (_, _, _, least_value, least_match) in enumerate(specs):
        fits = fits | ((F.col("kind") == i) & (F.length("value") >= least_value) & (F.col("width") >= least_match))
    rows = rows.where(fits).select("key_a", "key_b", "kind", "start", "end", F.sha2(F.col("value"), 256).alias("hash"))
    # An added token that overlaps a base span is dropped: compare with the furthest base end so far and the next start.
    own = W.partitionBy("key_a", "key_b").orderBy("start", "kind")
    base = F.col("kind") < len(BASE)
    reached = F.max(F.when(base, F.col("end"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    nearest = F.min(F.when(base, F.col("start"))).over(own.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumns({"_reached": reached, "_next": nearest})
    clear = F.coalesce(F.col("_reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    return rows.where(base | clear).drop("_reached", "_next")


def holders(docs: DataFrame, owner_col: str, repo_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Who holds each row: key_a, key_b, owner, repo, once each. Rows of equal id and text may have many owners."""
    a, b = row_key(id_col, text_col)
    owner, repo = ref(owner_col).cast("string").alias("owner"), ref(repo_col).cast("string").alias("repo")
    return docs.select(a.alias("key_a"), b.alias("key_b"), owner, repo).distinct()


def ownership(found: DataFrame, held: DataFrame) -> DataFrame:
    """Per hash: owners and repositories (distinct) whose rows hold it. Each step is combined before its shuffle."""
    values = found.select("key_a", "key_b", "hash").distinct()
    once = values.join(held, ["key_a", "key_b"]).groupBy("hash", "owner", "repo").agg(F.lit(1).alias("_one"))
    owners = once.groupBy("hash", "owner").agg(F.lit(1).alias("_one")).groupBy("hash").agg(F.count("*").alias("owners"))
    repos = once.groupBy("hash", "repo").agg(F.lit(1).alias("_one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repos, "hash")


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Candidates with owners, repositories and live (few hold the value)."""
    found = settle(candidates(docs))
    held = found.join(settle(ownership(found, holders(docs, owner_col, repo_col))), "hash")
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)
    return held.withColumn("live", live)


def secret_report(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Per input row: doc_id, counts of base spans, their digest, all spans, and how many values look live or copied."""
    base = F.col("kind") < len(BASE)
    shown = scan(docs, owner_col, repo_col).where(base | F.col("live"))
    span = F.struct("start", "kind", "end")
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
        return F.array_join(text, ",")

    per_doc = shown.groupBy("key_a", "key_b").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sort_array(F.collect_list(F.when(base, span))).alias("_base"),
        F.sort_array(F.collect_list(span)).alias("_all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    per_doc = per_doc.select("*", joined(F.col("_base")).alias("_base_text"), joined(F.col("_all")).alias("_all_text"))
    a, b = row_key("doc_id", "text")
    rows = docs.select(ref("doc_id").alias("doc_id"), a.alias("key_a"), b.alias("key_b"))
    out = rows.join(materialise(per_doc.drop("_base", "_all")), ["key_a", "key_b"], "left")
    counts = [f"n_{k}" for k in KINDS[:3]] + ["n_live", "n_example"]
    return out.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.sha2(F.coalesce("_base_text", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("_all_text", F.lit("")).alias("spans"),
    )
