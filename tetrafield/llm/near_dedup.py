"""Near-duplicate components by MinHash: many universal hash minima, banding, signature and full-set verification.

Documents of equal shingle sets form a class and go on as one. Classes that agree on all minima of a band share a
bucket; of buckets with the same members one is enough. First every member meets its bucket's best connected member, the
likeliest hub: that is one candidate row for each membership. Members that a confirmed link has brought into one component
need no comparison among themselves, so only pairs across components remain. They are compared in rounds of pivots, drawn
from outside the bucket's largest component until none are left there, which finds the same components as comparing
all pairs of the bucket. A pair must pass an estimate from the signatures, with a wide margin, and is confirmed on
the full shingle sets in integers. The rounds do all of this inside blocks of array operations (a chunk of members
and a chunk of pivots, with their sets), and a block gives back only links that join two of its components: fewer rows
than it has members, however many pairs it compares or rejects. A true link is missed only if no band of it agrees
(2e-6, as (1 - 0.85**7)**34 and (1 - 0.8**6)**44) or the estimate falls 4 standard errors short.

Cases: null or empty text, or white space only, has no shingles and is linked with nothing; a text of fewer than five
words is one shingle; very long texts are shingled whole; rows that repeat one id are documents of their own, which differ
only where their texts do; a null doc_id never becomes a component's name unless no other is there; an empty table
gives an empty result. Clashing input columns (n_shingles, component_id, kept) are replaced by link and kept by deduplicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, batches_of, give_back, partitions
from .components import components

WORDS = 5
PERCENT = 85  # a link: 100 * intersection >= percent * union
BANDING = {85: (34, 7), 80: (44, 6)}  # bands and rows of each percent in use
SLACK = 0.1  # an estimate may fall so far short of percent: over 4 standard errors of bands * rows minima
PIVOTS = 64  # of a bucket in its second round, about; GROWTH times as many in each later one
GROWTH = 32
CHUNK, CHUNK_SHINGLES = 2048, 1 << 19  # members of a bucket, and their shingles, in one block: what a block holds is bounded by these
DEAL_SHINGLES = 1 << 21  # of the blocks that a task's group holds together
BLOCK_BYTES = 1 << 18  # of text hashed at once; a worker holds some 40 bytes for each
BATCH_ROWS = 1024  # of texts that pass to a worker at once
SLICE_ROWS = 256  # of a batch that are Python objects at once
ADDED = ("n_shingles", "component_id", "kept")

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLACE = mix(np.arange(1, 1025, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_TURN = mix(np.arange(5001, 5001 + WORDS, dtype=_U)) | _U(1)
_COUNT = mix(np.arange(6001, 6002 + WORDS, dtype=_U))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_MOST = max(bands * rows for bands, rows in BANDING.values())
_A = mix(np.arange(1, _MOST + 1, dtype=_U)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(10_001, _MOST + 10_001, dtype=_U)) >> _U(32)).astype(np.uint32)
_BAND = mix(np.arange(20_001, 20_001 + _MOST, dtype=_U)) | _U(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    return _PLACE


def _sets_of(raw: list[bytes]) -> list[np.ndarray]:
    size = np.array([len(x) + 1 for x in raw], np.int64)
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK[flat]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, _U)] * len(raw)
    word = np.cumsum(first) - 1
    place = np.arange(len(flat)) - starts[np.maximum(word, 0)]
    place[blank] = 0
    value = (_FOLD[flat].astype(_U) + _U(1)) * _places(int(place.max()) + 1)[place]
    value[blank] = 0
    hashed = mix(np.add.reduceat(value, starts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
    n = len(hashed) - WORDS + 1
    runs = np.zeros(0, _U)
    if n > 0:
        runs = hashed[:n] * _TURN[0]
        for k in range(1, WORDS):
            runs = runs + hashed[k : k + n] * _TURN[k]
        runs = mix(runs + _COUNT[WORDS])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((hashed[a:b] * _TURN[: b - a]).sum(dtype=_U, keepdims=True) + _COUNT[b - a]))
        else:
            out.append(np.zeros(0, _U))
    return out


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, computed for a block of texts at a time."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        block.append(raw)
        size += len(raw)
        if size > BLOCK_BYTES:
            yield from _sets_of(block)
            block, size = [], 0
    if block:
        yield from _sets_of(block)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(documents, count) minima of the universal hashes a * x + b mod 2**32; the sets aren't empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    out, own = np.empty((count, len(sets)), np.uint32), np.empty_like(x)
    for j in range(count):
        np.multiply(x, _A[j], out=own)
        np.add(own, _B[j], out=own)
        out[j] = np.minimum.reduceat(own, starts)
    return out.T


SKETCH = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
DIGEST = ["set_a", "set_b", "n_shingles"]


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, mark, n_shingles, set_a, set_b: a 128-bit digest of the set, signature: the low byte of each minimum, bands) of docs (id, mark, text)."""
    bands, rows_each = BANDING[percent]
    turns = _BAND[: bands * rows_each].reshape(bands, rows_each)

    def flush(group: list, rows: list) -> None:
        minima = signatures([s for *_, s in group], bands * rows_each)
        small = minima.astype(np.uint8)
        # of the bytes, so that the signature alone tells which buckets two documents share
        wide = small.astype(_U).reshape(len(group), bands, rows_each)
        keys = mix((wide * turns).sum(2, dtype=_U) + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
        for (i, m, s), sign, key in zip(group, small, keys, strict=True):
            a, b = mix(s + _U(1)).sum(dtype=_U), mix(s ^ _U(0x5555555555555555)).sum(dtype=_U)
            rows.append((i, m, len(s), int(a.view(np.int64)), int(b.view(np.int64)), sign.tobytes(), key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                rows: list[tuple] = []
                group: list[tuple] = []
                n = 0
                ids, marks, texts = (part.column(c).to_pylist() for c in range(3))
                for i, m, s in zip(ids, marks, shingle_sets(texts), strict=True):
                    if not len(s):
                        rows.append((i, m, 0, None, None, None, None))
                        continue
                    group.append((i, m, s))
                    n += len(s)
                    if n > 30_000:  # so that it stays in the processor's cache
                        flush(group, rows)
                        group, n = [], 0
                if group:
                    flush(group, rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SKETCH.types, strict=True)], schema=SKETCH)
        give_back()

    schema = "id long, mark long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"
    return docs.select("id", "mark", "text").mapInArrow(run, schema)


def with_sets(rows: DataFrame) -> DataFrame:
    """rows (..., text) with the text's sorted shingle hashes (binary, 64 bits each) in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column(part.num_columns - 1).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], sets], [*part.schema.names[:-1], "shingles"])
        give_back()

    columns = [c for c in rows.columns if c != "text"]
    return rows.select(*columns, "text").mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(columns).schema), "shingles binary"]))


@F.arrow_udf(T.DoubleType())
def estimate(a: pa.Array, b: pa.Array) -> pa.Array:
    """Similarity by the share of agreeing minima, corrected for bytes that agree by chance."""
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pa.array(((x == y).mean(1) - 1 / 256) / (1 - 1 / 256))


def _shingles(sets: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in sets.to_pylist()]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. sets: (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                keep = []
                for a, b in zip(_shingles(part.column(2)), _shingles(part.column(3)), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("_b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "_a", "_b").mapInArrow(run, "u long, v long")


def block_links(a: dict[str, np.ndarray], b: dict[str, np.ndarray], a_sets: list[np.ndarray], b_sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of members a and pivots b that join two components of the block.

    Both: node, comp, turn (the round in which it was or is a pivot, else 0) and signature. A pair of pivots is compared once: in the
    later one's round, and of two of one round by the one with the larger node.
    """
    sizes, own_sizes = (np.array([len(s) for s in x], np.int64) for x in (a_sets, b_sets))
    _, label = np.unique(np.concatenate([a["comp"], b["comp"]]), return_inverse=True)
    here, there = label[: len(sizes)].copy(), label[len(sizes) :].copy()
    minima = a["signature"].shape[1]
    least = ((percent / 100 - SLACK) * (1 - 1 / 256) + 1 / 256) * minima
    place = mine = flag = None
    starts = np.cumsum(sizes) - sizes
    links = []
    for n in range(len(own_sizes)):
        node, turn, size = b["node"][n], b["turn"][n], own_sizes[n]
        open_ = (here != there[n]) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
        open_ &= ~((a["turn"] > 0) & ((a["turn"] < turn) | (a["turn"] == turn) & (a["node"] > node)))
        near = np.flatnonzero(open_)
        near = near[(a["signature"][near] == b["signature"][n]).sum(1, dtype=np.int32) >= least]
        if not len(near):
            continue
        if place is None:  # the block's shingles by number, so that a set becomes a flag for each
            values, place = np.unique(np.concatenate([*a_sets, *b_sets]), return_inverse=True)
            place, mine = place[: starts[-1] + sizes[-1]], np.split(place[starts[-1] + sizes[-1] :], np.cumsum(own_sizes)[:-1])
            flag = np.zeros(len(values), bool)
        flag[mine[n]] = True
        many, ends = sizes[near], np.cumsum(sizes[near])
        both = np.add.reduceat(flag[place[np.repeat(starts[near] - (ends - many), many) + np.arange(ends[-1])]], ends - many, dtype=np.int64)
        flag[mine[n]] = False
        near = near[100 * both >= percent * (many + size - both)]
        if len(near):
            others, first = np.unique(here[near], return_index=True)
            links += [(int(a["node"][i]), int(node)) for i in near[first].tolist()]
            here[np.isin(here, others)] = there[n]
            there[np.isin(there, others)] = there[n]
    return links


BLOCK = ["deal", "key", "left", "right", "node", "comp", "turn", "signature", "shingles"]


def across_blocks(members: DataFrame, pivots: DataFrame, groups: int, percent: int = PERCENT) -> DataFrame:
    """(u, v): links between components of a bucket, from blocks of its members and pivots (both with BLOCK's columns)."""

    def sorted_out(table: pa.Table) -> tuple[dict[tuple, slice], dict[str, np.ndarray], list[np.ndarray]]:
        """Where each block lies, and the columns in that order."""
        own = {c: table.column(c).to_numpy() for c in BLOCK[1:-2]}
        order = np.lexsort((own["node"], own["right"], own["left"], own["key"]))
        own = {c: v[order] for c, v in own.items()}
        own["signature"] = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        sets = _shingles(table.column("shingles"))
        cuts = np.flatnonzero((np.diff(own["key"]) != 0) | (np.diff(own["left"]) != 0) | (np.diff(own["right"]) != 0)) + 1
        ends = [0, *cuts.tolist(), len(order)]
        return {(int(own["key"][i]), int(own["left"][i]), int(own["right"][i])): slice(i, j) for i, j in zip(ends, ends[1:])}, own, [sets[i] for i in order.tolist()]

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if one.num_rows and other.num_rows:
            (places, a, a_sets), (mine, b, b_sets) = sorted_out(one), sorted_out(other)
            for block, at in mine.items():
                if there := places.get(block):
                    links += block_links({c: v[there] for c, v in a.items()}, {c: v[at] for c, v in b.items()}, a_sets[there], b_sets[at], percent)
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    # aliases give both sides columns of their own
    left, right = (side.withColumn("deal", F.pmod(F.xxhash64("key", "left", "right"), F.lit(groups)).cast("int")).select(*(F.col(c).alias(c) for c in BLOCK)) for side in (members, pivots))
    return left.groupBy("deal").cogroup(right.groupBy("deal")).applyInArrow(run, "u long, v long")


def _chunks(count: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / CHUNK), F.ceil(F.col(size) / CHUNK_SHINGLES), F.lit(1)).cast("int")


def _merged(known: DataFrame | None, links: DataFrame, keep: Written, name: str) -> DataFrame:
    """(node, comp) after the new links; nodes without a link are left out."""
    if known is None:
        return keep(components(links, keep, f"{name}-cc").select("node", F.col("component").alias("comp")), name)
    a, b = known.select(F.col("node").alias("u"), F.col("comp").alias("cu")), known.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    between = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    joined = keep(components(between, keep, f"{name}-cc").select(F.col("node").alias("comp"), F.col("component").alias("to")), f"{name}-to")
    # those that were no component's member before came in as themselves
    old = known.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = joined.select(F.col("comp").alias("node"), F.col("to").alias("comp")).join(known.select("node"), "node", "left_anti")
    return keep(old.unionByName(new), name)


def link(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs' ids (as id_col, long) with n_shingles, component_id and kept: one row for each row of docs. percent: a key of BANDING."""
    return _linked(spark, docs, id_col, text_col, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _linked(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    keep = Written(spark, "near")
    with batches_of(spark, BATCH_ROWS):  # all jobs with texts run within; what is returned only reads one written table
        result = keep(_link(spark, rows, percent, keep), "result")
        keep.drop_but("result")
    return result


def _link(spark: SparkSession, docs: DataFrame, percent: int, keep: Written) -> DataFrame:
    """(id, mark, n_shingles, component_id, kept). docs: (id, mark: a hash of the text, text)."""
    sketched = keep(sketch(docs, percent).withColumn("row", F.monotonically_increasing_id()), "sketch")
    classes = keep(sketched.filter("n_shingles > 0").groupBy(*DIGEST).agg(F.min("id").alias("rep"), F.min("row").alias("node")), "classes")
    reps = sketched.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")

    banded = keep(reps.select("node", F.explode("bands").alias("key")), "banded")
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *same).filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = keep(banded.join(shared, "key"), "members")
    keep.drop("banded")
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    # what may be compared: signature and set, read by every round
    involved = reps.join(degrees, "node").select("node", "degree", "n_shingles", "signature", F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    own_text = (docs["mark"] == F.col("_mark")) & docs["id"].eqNullSafe(F.col("_id"))
    involved = keep(with_sets(docs.join(involved, own_text).dropDuplicates(["node"]).select("node", "degree", "n_shingles", "signature", "text")), "involved")
    signs, sets = involved.select("node", "n_shingles", "signature"), involved.select("node", "shingles")

    def similar(pairs: DataFrame) -> DataFrame:
        left, right = signs.toDF("u", "_nu", "_su"), signs.toDF("v", "_nv", "_sv")
        both = pairs.join(left, "u").join(right, "v").filter(100 * F.least("_nu", "_nv") >= percent * F.greatest("_nu", "_nv"))
        return both.withColumn("est", estimate("_su", "_sv")).filter(F.col("est") >= percent / 100 - SLACK).select("u", "v", "est")

    # first round: with the bucket's hub
    ranked = members.join(involved.select("node", "degree"), "node")
    top = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("v"))
    hubbed = keep(members.join(top, "key"), "hubbed")
    pairs = hubbed.filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    likely = keep(similar(pairs), "likely")
    best = likely.groupBy("u").agg(F.max(F.struct("est", (-F.col("v")).alias("neg"))).alias("b")).select("u", (-F.col("b.neg")).alias("v"))
    comps = _merged(None, keep(confirmed(best, sets, percent), "links-best"), keep, "comps-best")

    def across(pairs: DataFrame) -> DataFrame:
        a, b = comps.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comps.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        open_ = F.coalesce("cu", "u") != F.coalesce("cv", "v")
        return pairs.join(a, "u", "left").join(b, "v", "left").filter(open_).select("u", "v")

    comps = _merged(comps, keep(confirmed(across(likely.select("u", "v")), sets, percent), "links-rest"), keep, "comps-rest")

    # later rounds: pivots from outside the bucket's largest component, against members of other components. A bucket
    # is done with, and no longer read, when all members outside its largest component have been pivots. A round joins
    # its members with their buckets once: a member's draw alone tells whether it is a pivot.
    state = hubbed.filter("n > 2").join(involved.select("node", "n_shingles"), "node")
    state = keep(state.select("key", "node", "n_shingles", F.when(F.col("node") == F.col("v"), 1).otherwise(0).alias("turn")), "state")
    waits, pivots = (F.col("turn") == 0).cast("long"), PIVOTS
    for step in range(2, 66):
        placed = state.join(comps, "node", "left").select("key", "node", "n_shingles", "turn", F.coalesce("comp", "node").alias("comp"))
        parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("size"), F.sum(waits).alias("w"), F.sum(waits * F.col("n_shingles")).alias("wsize"))
        whole = parts.groupBy("key").agg(F.max(F.struct("k", "comp", "w", "wsize")).alias("most"), *(F.sum(c).alias(c) for c in ("k", "size", "w", "wsize")))
        open_ = whole.select("key", "k", "size", F.col("most.comp").alias("largest"), (F.col("w") - F.col("most.w")).alias("w"), (F.col("wsize") - F.col("most.wsize")).alias("wsize")).filter("w > 0")
        open_ = open_.withColumn("share", F.least(F.lit(1.0), pivots / F.col("w"))).withColumns({"pn": F.col("w") * F.col("share"), "psize": F.col("wsize") * F.col("share")})
        plan = keep(open_.select("key", "largest", "share", _chunks("k", "size").alias("lefts"), _chunks("pn", "psize").alias("rights"), F.col("size").alias("_size"), "psize"), f"plan{step}")
        total = plan.agg(F.sum(F.col("_size").cast("double") * F.col("rights") + F.col("psize") * F.col("lefts"))).first()[0]
        if total is None:
            break
        groups = max(partitions(spark), math.ceil(total / DEAL_SHINGLES))
        chosen = (F.col("turn") == 0) & (F.col("comp") != F.col("largest")) & (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        turned = placed.join(plan, "key").withColumn("turn", F.when(chosen, step).otherwise(F.col("turn")))
        turned = keep(turned.select("key", "node", "n_shingles", "turn", "comp", "lefts", "rights"), f"open{step}")
        dealt = lambda own, way, others: own.withColumn(way, F.pmod(F.xxhash64("node"), F.col(f"{way}s")).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(f"{others}s") - 1)))
        own = signs.drop("n_shingles").join(sets, "node")
        links = keep(across_blocks(dealt(turned.join(own, "node"), "left", "right"), dealt(turned.filter(F.col("turn") == step).join(own, "node"), "right", "left"), groups, percent).distinct(), f"links{step}")
        if not links.isEmpty():
            comps = _merged(comps, links, keep, f"comps{step}")
        state = turned.select("key", "node", "n_shingles", "turn")
        pivots *= GROWTH
    else:
        raise RuntimeError("buckets did not settle")

    named = comps.join(classes.select("node", "rep"), "node")
    named = named.join(named.groupBy("comp").agg(F.min("rep").alias("name")), "comp").select("node", "name")
    placed = sketched.select("id", "mark", *DIGEST).join(classes.join(named, "node", "left").select(*DIGEST, F.coalesce("name", "rep").alias("_name")), DIGEST, "left")
    component = F.coalesce("_name", "id")
    return placed.select("id", "mark", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the near copies: of each component the rows with the smallest id stay; rows without an id that are linked with none stay."""
    gone = _linked(spark, docs, id_col, text_col, percent).filter("NOT kept").select(F.col("id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(text_col)) == F.col("_mark")), "left_anti")
