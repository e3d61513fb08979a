"""Mixing of sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) gets a budget of tokens at its root. Each node passes its budget to its
children in proportion to their weights; a child that can't use its part (its documents times the allowed epochs) takes
what it can, and the rest goes to its siblings in the same proportions. As capacities are summed over whole subtrees
first, a shortage meets siblings before it meets the parent's siblings. A leaf repeats its documents for whole epochs
and takes a token-prefix of one more: documents in the order of a seeded hash that differs by epoch, as long as their
running total stays within what is left.

The prefix needs no sort of a leaf: tokens are summed by leaf and hash bucket, the bucket in which the budget runs out
is found from running sums over at most 65536 buckets, and only that bucket's documents are put in order.

Cases: null text has no tokens; such rows cost nothing and are taken with the others of their place in the order (a leaf without any token once); null
levels form a branch of their own, named ''; rows that repeat count each; ties of the hash go to the smaller id; an
empty table, or a budget of 0, selects nothing; clashing input columns (n_tokens, copies and the levels' names) are replaced
by mix and kept by take.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Written, text_or_empty

SEED = 20
EPOCHS = 2
SHARE = 0.8  # of the corpus's tokens
BROADCAST_LEAVES = 20_000  # a larger tree is joined by shuffling
# Weights of nodes below the root, by path; 1 where none is given.
WEIGHTS = {"src/en": 4.0, "src/de": 2.0, "src/fr": 2.0, "src/es": 2.0}
ADDED = ("n_tokens", "copies")


def document_levels() -> list[tuple[str, Column]]:
    """Domain (a source's name without its number), language and source."""
    return [("domain", F.regexp_extract(F.coalesce("source", F.lit("")), r"^[^0-9]*", 0)), ("lang_level", F.coalesce("lang", F.lit(""))), ("source_level", F.coalesce("source", F.lit("")))]


def tokens(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _key(seed: int, epoch: str | Column, id_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch, F.col(id_col)).cast("binary"))


def _share(nodes: DataFrame) -> DataFrame:
    """Water-filling among the children of each parent. nodes: parent, path, weight, capacity, budget (the parent's)."""
    by = Window.partitionBy("parent").orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))), "path")
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.col("_before")) / F.col("_weights")
    out = nodes.withColumn("_before", F.sum("capacity").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("capacity")).withColumn("_weights", F.sum("weight").over(rest))
    full = F.col("capacity") * F.col("_weights") <= (F.col("budget") - F.col("_before")) * F.col("weight")
    out = out.withColumn("_level", F.when(~full & (F.col("_weights") > 0), level))
    # levels of the children that don't fill up start at the true one, which is the first
    first = F.first("_level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("_first", first)
    got = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("_first").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("_first") * F.col("weight")))
    return out.select("path", F.greatest(got, F.lit(0.0)).alias("budget"))


def budgets(spark: SparkSession, leaves: DataFrame, names: list[str], weights: Mapping[str, float], share: float, epochs: int) -> DataFrame:
    """leaves (names..., total) with budget: the tokens each may give. The tables are as large as the tree."""
    weighed = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 1.0)], "path string, weight double")
    paths = [F.concat_ws("/", *(F.col(n) for n in names[: d + 1])) for d in range(len(names))]
    cap = leaves.withColumn("capacity", F.col("total").cast("double") * epochs)
    budget = cap.agg(F.lit("").alias("path"), F.least(F.floor(F.sum("total") * F.lit(share)).cast("double"), F.sum("capacity")).alias("budget"))
    for d in range(len(names)):
        parent = paths[d - 1] if d else F.lit("")
        nodes = cap.groupBy(parent.alias("parent"), paths[d].alias("path")).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(weighed, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        budget = _share(nodes.join(budget.withColumnRenamed("path", "parent"), "parent"))
    return leaves.withColumn("path", paths[-1]).join(budget, "path").withColumn("budget", F.floor(F.round("budget", 3)).cast("long")).drop("path")


def mix(spark: SparkSession, docs: DataFrame, levels: list[tuple[str, Column]], weights: Mapping[str, float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the levels, n_tokens and copies (how often the row is taken; 0: not at all)."""
    names = [n for n, _ in levels]
    rows = docs.select(*(c for c in docs.columns if c not in (*ADDED, *names))).withColumns(dict(levels)).withColumn("n_tokens", tokens(text_col))
    keep = Written(spark, "mixing")
    narrow = keep(rows.select(F.col(id_col).alias("_id"), *names, "n_tokens"), "narrow")
    leaves = keep(budgets(spark, narrow.groupBy(*names).agg(F.sum("n_tokens").alias("total")), names, weights, share, epochs), "leaves")
    planned = leaves.select(*names, "budget", F.when(F.col("total") > 0, F.least(F.floor(F.col("budget") / F.col("total")), F.lit(epochs))).otherwise(F.lit(0)).cast("long").alias("full"), "total")
    planned = planned.withColumn("_left", F.col("budget") - F.col("full") * F.col("total")).withColumn("_epoch", F.col("full"))
    small = leaves.count() <= BROADCAST_LEAVES

    def leafwise(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, names)

    bucket = F.substring("_key", 1, 4)
    summed = leafwise(narrow, planned.select(*names, "_epoch")).withColumn("_key", _key(seed, "_epoch", "_id")).groupBy(*names, bucket.alias("_bucket")).agg(F.sum("n_tokens").alias("_n"))
    running = summed.withColumn("_before", F.sum("_n").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    edge = leafwise(running, planned.select(*names, "_left")).filter(F.col("_before") + F.col("_n") > F.col("_left")).groupBy(*names).agg(F.min(F.struct("_bucket", "_before")).alias("_edge"))
    # a leaf that runs out nowhere takes all: with epochs left over, when its budget ends at a whole epoch, its first bucket is the edge
    plan = keep(planned.join(edge, names, "left").select(*names, "full", "_epoch", "_left", F.col("_edge._bucket").alias("_at"), F.col("_edge._before").alias("_before")), "plan")
    keyed = leafwise(rows, plan).withColumn("_key", _key(seed, "_epoch", id_col))
    spare = F.col("full") < epochs
    sure = keyed.filter(F.coalesce(bucket != F.col("_at"), F.lit(True))).withColumn("_more", F.when(spare & F.coalesce(bucket < F.col("_at"), F.lit(True)), 1).otherwise(0))
    order = Window.partitionBy(*names).orderBy("_key", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edgy = keyed.filter(bucket == F.col("_at")).withColumn("_more", F.when(spare & (F.sum("n_tokens").over(order) + F.col("_before") <= F.col("_left")), 1).otherwise(0))
    return sure.unionByName(edgy).select(*rows.columns, (F.col("full") + F.col("_more")).alias("copies"))


def take(spark: SparkSession, docs: DataFrame, levels: list[tuple[str, Column]], **options) -> DataFrame:
    """The mixture itself: docs' columns, clashing ones too, a row as often as it is taken."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in (*ADDED, *(n for n, _ in levels))}
    mixed = mix(spark, docs.withColumnsRenamed(clash), levels, **options).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
