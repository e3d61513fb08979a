"""Exact deduplication by two-pass Bloom filtering.

Pass one adds the k slots of every row's hash to a counter per slot and keeps, as a bitmap, the slots that two rows or
more fell into. Pass two reads the rows again: a row of which one slot was hit by no other row is the only one of its
text and passes straight through; the others ("possibly repeated") shuffle to be grouped by their full digest. The
filter has SLOTS_PER_ROW slots for each row, rounded up to a power of two, and at most 2**MOST_LOG2: so its size is bounded,
and what may be broadcast with it (128 MB for each hash). Beyond that many rows it fills up, which lets more rows shuffle
and never changes the result.

Cases: null text counts as empty; an empty table gives an empty result; ties (rows that repeat both text and doc_id)
keep exactly one of the equal rows; a null doc_id sorts last, so it stays only where a text has no other row. Columns of
the input that clash with added names are replaced by mark and kept by deduplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Written, text_or_empty

BITMAP_BITS = 32768  # of bitmap_construct_agg
SLOTS_PER_ROW, MOST_LOG2 = 8, 30
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def _slots(digest: Column, hashes: int, slots_log2: int) -> list[Column]:
    """Slot numbers from disjoint parts of the digest."""
    return [F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("long") % F.lit(1 << slots_log2) for k in range(hashes)]


def repeated_slots(digests: DataFrame, hashes: int, slots_log2: int) -> DataFrame:
    """(k, bucket, bits): bitmaps of the slots hit twice or more. Counts combine before the shuffle, so a hot text is one row a task."""
    each = digests.select(F.posexplode(F.array(*_slots(F.col("text_sha256"), hashes, slots_log2))).alias("k", "slot"))
    twice = each.groupBy("k", "slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("k", F.expr(f"slot div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"slot % {BITMAP_BITS}")).alias("bits"))


def _sorted_out(rows: DataFrame, bitmaps: DataFrame, hashes: int, slots_log2: int) -> DataFrame:
    """rows with _maybe: whether every slot of the row's hash was hit at least twice."""
    if not 10 <= slots_log2 <= MOST_LOG2 or not 1 <= hashes <= 4:
        raise ValueError(f"10 <= slots_log2 <= {MOST_LOG2} and 1 <= hashes <= 4, so that the filter's size is bounded")
    tested, hit = rows, F.lit(True)
    for k, slot in enumerate(_slots(F.col("text_sha256"), hashes, slots_log2)):
        own = bitmaps.filter(F.col("k") == k).select(F.col("bucket").alias("_bucket"), F.col("bits").alias(f"_bits{k}"))
        # at most 2**slots_log2 bits in all, see above: safe to broadcast at any input size
        tested = tested.withColumn(f"_slot{k}", slot).join(F.broadcast(own), F.expr(f"_slot{k} div {BITMAP_BITS}") == F.col("_bucket"), "left").drop("_bucket")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{k}"), (F.expr(f"_slot{k} % {BITMAP_BITS} div 8") + 1).cast("int"), 1)), 16, 10).cast("int")
        hit = hit & F.coalesce(F.getbit(byte, (F.col(f"_slot{k}") % 8).cast("int")) == 1, F.lit(False))
    return tested.withColumn("_maybe", hit).drop(*(f"_{x}{k}" for k in range(hashes) for x in ("slot", "bits")))


def filter_size(n_rows: int) -> int:
    """The power of two slots for so many rows."""
    return min(max(10, (SLOTS_PER_ROW * n_rows - 1).bit_length()), MOST_LOG2)


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    rows = docs.drop(*(c for c in ADDED if c in docs.columns))
    return rows.withColumn("text_sha256", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))


def mark(rows: DataFrame, id_col: str = "doc_id", hashes: int = 2, slots_log2: int | None = None) -> DataFrame:
    """rows (with_digest's, best without the text and written) with keep_id, group_size and kept added; every row stays.

    slots_log2: if None, by the number of rows, which are counted first.
    """
    slots_log2 = filter_size(rows.count()) if slots_log2 is None else slots_log2
    tested = _sorted_out(rows, repeated_slots(rows.select("text_sha256"), hashes, slots_log2), hashes, slots_log2)
    once = tested.filter(~F.col("_maybe")).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    maybe = tested.filter("_maybe")
    groups = maybe.groupBy("text_sha256").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Only rows that carry the smallest id can stay; where they are repeated one of them does.
    linked = maybe.join(groups, "text_sha256").withColumn("_first", F.col(id_col).eqNullSafe(F.col("keep_id")))
    first = linked.filter("_first").withColumn("_n", F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy(id_col)))
    more = first.withColumn("kept", F.col("_n") == 1).drop("_n").unionByName(linked.filter("NOT _first").withColumn("kept", F.lit(False)))
    return once.unionByName(more.drop("_first")).select(*(c for c in rows.columns if c != "text_sha256"), *ADDED)


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = 2, slots_log2: int | None = None) -> DataFrame:
    """The rows of docs that stay, with their own columns. Of the texts only those shuffle that may be repeated."""
    clash = [c for c in ADDED if c in docs.columns]
    docs = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    keep = Written(spark, "exact")
    rows = with_digest(docs, text_col)
    narrow = keep(rows.select(id_col, "text_sha256"), "digests")
    slots_log2 = filter_size(narrow.count()) if slots_log2 is None else slots_log2
    bitmaps = keep(repeated_slots(narrow.select("text_sha256"), hashes, slots_log2), "bitmaps")
    groups = _sorted_out(narrow, bitmaps, hashes, slots_log2).filter("_maybe").groupBy("text_sha256").agg(F.min(id_col).alias("_keep"))
    tested = _sorted_out(rows, bitmaps, hashes, slots_log2)
    first = tested.filter("_maybe").join(groups, "text_sha256").filter(F.col(id_col).eqNullSafe(F.col("_keep")))
    one = first.withColumn("_n", F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy(id_col))).filter("_n = 1")
    stay = tested.filter("NOT _maybe").select(*docs.columns).unionByName(one.select(*docs.columns))
    return stay.withColumnsRenamed({f"_own_{c}": c for c in clash})
