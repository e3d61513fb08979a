"""Conversations repaired at least cost: the cheapest edits that make turns alternate, by search from both ends of an edit lattice.

A lattice node is (rows passed, what came last: nothing, system, user, assistant). Edges keep, rerole or delete the next row or insert
an empty one. A forward and a reverse heap settle nodes by cost; once no cheaper meeting is possible, all crossings of the least
cost are finished, and the least concatenated audit among them is taken. That is exact, because two audits of equal cost to one node
can't be one the beginning of the other: what the longer has more would be inserts, which cost.

Rows go to tasks by ranges of (conversation, turn), so that a conversation of any length is spread; it is cut into segments of at most
SEGMENT rows. One that lies whole within a task is finished there. Of others, each segment gives the cheapest audit for each
(state before, state after); a conversation's segments are chained by those alone, and then every segment writes its own repaired text.

Faults are counted before repair, the first that applies to a row: blank, duplicate (role and text seen earlier in the conversation),
truncated. Blank and duplicate rows have to go; a truncated one costs 3 more if it stays.

Cases: null roles and texts count as one space; rows go by turn, nulls first, then by role and text; rows that repeat are duplicates; a
null conversation id is a conversation of its own; one whose rows are all absent has zeros, no audit and no text, as an empty table
has no rows. An empty role adds no initial. Texts of any length are kept whole. Other columns aren't read, so none can clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, batches_of, partitions

SEGMENT = 256  # rows
SEGMENT_CHARS = 4 << 20  # and of text, but for single rows
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT: of a truncated row that stays

START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER} | {(s, ""): s for s in range(4)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a rerole or an insert leads to
BEFORE = {t: [s for s in range(4) if NEXT[s] == t] for t in range(4)}
KEPT_FROM = {}
for (_s, _r), _t in AFTER.items():
    KEPT_FROM.setdefault((_t, _r), []).append(_s)
ENDED = (START, ASSISTANT)
LEGAL = frozenset(("su", "ua", "au"))

Row = tuple[str, bool, int]  # a row's role initial, whether it has to go, and what it costs to stay


def damage(rows: DataFrame) -> DataFrame:
    """Damages conversation rows by a hash of conv_id and turn, for trials: conv_id, turn, role, text, absent (dropped rows stay, marked)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind"))
    changed = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    own = own.withColumns({"text": changed, "role": F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")), "_n": F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, F.lit(2)).otherwise(F.lit(1))))})
    return own.select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("absent"))


def forward(rows: list[Row], node: int) -> Iterator[tuple[int, int, str]]:
    """(node, cost, initial) of the edges that leave a node."""
    at, state = divmod(node, 4)
    to = NEXT[state]
    yield node - state + to, INSERT, "I"
    if at < len(rows):
        initial, goes, cost = rows[at]
        yield node + 4, DELETE, "D"
        if not goes:
            kept = AFTER.get((state, initial))
            if kept is not None:
                yield 4 * at + 4 + kept, cost + KEEP, "K"
            yield 4 * at + 4 + to, cost + REROLE, "R"


def backward(rows: list[Row], node: int) -> Iterator[tuple[int, int, str]]:
    """The edges that lead to a node, as (node they leave, cost, initial)."""
    at, state = divmod(node, 4)
    for s in BEFORE[state]:
        yield node - state + s, INSERT, "I"
    if at:
        initial, goes, cost = rows[at - 1]
        yield node - 4, DELETE, "D"
        if not goes:
            for s in KEPT_FROM.get((state, initial), ()):
                yield 4 * at - 4 + s, cost + KEEP, "K"
            for s in BEFORE[state]:
                yield 4 * at - 4 + s, cost + REROLE, "R"


def cheapest(rows: list[Row], start: int = START, goals: Iterable[int] = ENDED) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way from a state before the rows to one of the states after them; None if there is none."""
    last = 4 * len(rows)
    sides = (forward, backward)
    seen = ({start: (0, "")}, {last + g: (0, "") for g in goals})
    heaps = ([(0, 0, start)], [(0, -len(rows), node) for node in seen[1]])
    done: tuple[dict, dict] = ({}, {})
    least = inf = float("inf")
    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else inf for h in heaps]
        if min(tops) > 0 and sum(tops) > least:
            break
        side = 0 if tops[0] <= tops[1] else 1
        cost, _, node = heapq.heappop(heaps[side])
        own, other = done[side], done[1 - side]
        if node in own:
            continue
        own[node] = _, audit = seen[side][node]
        if node in other:
            least = min(least, cost + other[node][0])
        for to, more, initial in sides[side](rows, node):
            total = cost + more
            if to in other:
                least = min(least, total + other[to][0])
            if to in own:
                continue
            # nodes of equal cost are popped in the direction of the rows, so free edges are all known when a node is
            old, new = seen[side].get(to), (total, audit + initial if side == 0 else initial + audit)
            if old is None or new < old:
                seen[side][to] = new
                if old is None or total < old[0]:
                    heapq.heappush(heaps[side], (total, to // 4 if side == 0 else -(to // 4), to))
    if least == inf:
        return None
    found = [a + done[1][n][1] for n, (c, a) in done[0].items() if n in done[1] and c + done[1][n][0] == least]
    for node, (cost, audit) in done[0].items():
        if cost <= least:
            found += [audit + initial + done[1][to][1] for to, more, initial in forward(rows, node) if to in done[1] and cost + more + done[1][to][0] == least]
    return least, min(found)


def applied(audit: str, turns: list[tuple[str, str]], state: int = START) -> list[tuple[str, str]]:
    """(role, text) after the edits."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(("user" if state == USER else "assistant", ""))
            continue
        role, text = turns[at]
        at += 1
        if edit == "K":
            state = AFTER[state, role[:1]]
            out.append((role, text))
        elif edit == "R":
            state = NEXT[state]
            out.append(("user" if state == USER else "assistant", text))
    return out


def written(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in turns)


class Segment:
    """Consecutive rows of one conversation with their faults."""

    def __init__(self, most: int = SEGMENT):
        self.most = most
        self.turns: list[tuple[str, str]] = []
        self.rows: list[Row] = []
        self.numbers: list[int] = []  # distinct turns in order
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        inner = text.rstrip(SPACES)
        blank, cut = not inner, inner[-1:] not in ENDS
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not blank and not seen
        if self.rows:
            self.illegal += self.rows[-1][0] + role[:1] not in LEGAL
        self.rows.append((role[:1], blank or seen, CUT if cut else 0))
        self.turns.append((role, text))
        self.chars += len(text)
        if turn is not None and self.numbers[-1:] != [turn]:
            self.numbers.append(turn)

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.most or self.chars >= SEGMENT_CHARS


WAY = "array<struct<s:int,t:int,cost:long,audit:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
NUMBERS = ("low", "high", "turns")  # least and greatest turn, and how many distinct ones
PARTS = f"conv_id {{id}}, whole boolean, task int, place int, rows int, first string, last string, low long, high long, turns long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired string, roles array<string>, texts array<string>, ways {WAY}"
PLAIN = ("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired")


def _row(conv, task: int, place: int, whole: bool, s: Segment) -> dict:
    out = {
        "conv_id": conv, "whole": whole, "task": task, "place": place, "rows": len(s.rows), "first": s.rows[0][0] if s.rows else None, "last": s.rows[-1][0] if s.rows else None,
        "low": s.numbers[0] if s.numbers else None, "high": s.numbers[-1] if s.numbers else None, "turns": len(s.numbers), **{c: int(getattr(s, c)) for c in COUNTS},
    }
    if whole:
        cost, audit = cheapest(s.rows)
        return out | {"cost": cost, "audit": audit, "repaired": written(applied(audit, s.turns)), "roles": None, "texts": None, "ways": None}
    ways = [{"s": a, "t": b, "cost": got[0], "audit": got[1]} for a in range(4) for b in range(4) if (got := cheapest(s.rows, a, (b,))) is not None]
    return out | {"cost": None, "audit": None, "repaired": None, "roles": [r for r, _ in s.turns], "texts": [t for _, t in s.turns], "ways": ways}


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Sorted rows (conv_id, turn, role, text, n, seen) as rows of PARTS."""
    schema = PARTS.format(id=rows.schema["conv_id"].dataType.simpleString())
    empty = rows.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, own, place = TaskContext.get().partitionId(), None, None, 0
        first, opened = True, False  # a task's first and last conversation may go on in others; full segments go out at once
        out: list[dict] = []
        chars = 0

        def close(whole: bool) -> None:
            nonlocal place, chars
            if own.rows or not opened:
                out.append(_row(conv, task, place, whole, own))
                place += 1
                chars += own.chars

        for batch in batches:
            for name, turn, role, text, n, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or name != conv:
                    if own is not None:
                        close(not first and not opened)
                        first = False
                    conv, own, opened = name, Segment(most), False
                for k in range(n):
                    if own.full:
                        close(False)
                        own, opened = Segment(most), True
                    own.add(turn, role, text, seen or k > 0)
                if len(out) >= 512 or chars > SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, chars = [], 0
        if own is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


def chained(parts: DataFrame) -> DataFrame:
    """For each segment of a conversation in several: the state before it and its edits; the conversation's numbers stand at the first one."""
    conv = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, task int, place int, state int, edits string, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parts.sparkSession.createDataFrame([], schema).schema)

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: (r["task"], r["place"]))
        best: dict[int, tuple[int, str]] = {START: (0, "")}
        came: list[dict[int, tuple[int, str]]] = []
        for r in own:
            after: dict[int, tuple[int, str]] = {}
            how: dict[int, tuple[int, str]] = {}
            for w in r["ways"]:
                if w["s"] in best:
                    cost, audit = best[w["s"]]
                    made = (cost + w["cost"], audit + w["audit"])
                    if w["t"] not in after or made < after[w["t"]]:
                        after[w["t"]], how[w["t"]] = made, (w["s"], w["audit"])
            best = after
            came.append(how)
        (cost, audit), state = min((best[s], s) for s in ENDED if s in best)
        chosen = []
        for how in reversed(came):
            state, edits = how[state]
            chosen.append((state, edits))
        filled = [r for r in own if r["rows"]]
        numbered = [r for r in own if r["turns"]]
        twice = sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
        total = {c: sum(r[c] for r in own) for c in COUNTS}
        total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:]))
        total["gaps"] = numbered[-1]["high"] - numbered[0]["low"] + 1 - sum(r["turns"] for r in numbered) + twice if numbered else 0
        out = [{"conv_id": r["conv_id"], "task": r["task"], "place": r["place"], "state": s, "edits": e} for r, (s, e) in zip(own, reversed(chosen), strict=True)]
        out[0] |= total | {"cost": cost, "audit": audit}
        return pa.Table.from_pylist(out, arrow)

    lean = parts.select("conv_id", "task", "place", "rows", "first", "last", *NUMBERS, *COUNTS, "ways")
    return lean.groupBy("conv_id").applyInArrow(chain, schema)


def joined(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Conversations in several segments: each writes its own text, and the texts are put together in order."""
    both = chosen.join(parts.select("task", "place", "roles", "texts"), ["task", "place"])
    kept = [c for c in both.columns if c not in ("roles", "texts", "state", "edits")]
    schema = ", ".join([*(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in kept), "own string"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for state, edits, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("state", "edits", "roles", "texts")), strict=True):
                turns = applied(edits, list(zip(roles, texts, strict=True)), state)
                made.append(written(turns) if turns else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string())], [*kept, "own"])

    texts = both.mapInArrow(write, schema)
    ordered = F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("task", "place", "own"))))
    numbers = [F.max(c).alias(c) for c in ("gaps", *COUNTS, "cost", "audit")]
    return texts.groupBy("conv_id").agg(*numbers, F.array_join(F.transform(ordered, lambda x: x["own"]), "\n").alias("repaired")).select(*PLAIN)


def repair(spark: SparkSession, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of rows conv_id, turn, role, text and, if there, absent (rows that only say that a conversation exists)."""
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in rows.columns else F.lit(False)
    live = lambda c: F.when(~F.col("_absent"), c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.withColumn("_absent", absent)
    own = own.select("conv_id", live(F.col("turn").cast("long")).alias("turn"), live(text("role")).alias("role"), live(text("text")).alias("text"), live(F.lit(1)).alias("_live"))
    keep = Written(spark, "conversations")
    own = keep(own.groupBy("conv_id", "turn", "role", "text").agg(F.count("_live").cast("int").alias("n")), "rows")
    # where a role and text first occur, if they occur at several turns
    digest = F.md5(F.col("text").cast("binary"))
    firsts = own.filter("n > 0").groupBy("conv_id", "role", digest.alias("digest")).agg(F.count(F.lit(1)).alias("times"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("untold")).filter("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), "digest", "least", "untold")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (digest == F.col("digest"))
    seen = F.coalesce(F.when(F.col("untold"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    own = keep(own.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "n", seen.alias("seen")), "marked")
    keep.drop("rows")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    dealt = own.repartitionByRange(partitions(spark), *order, F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    with batches_of(spark, 1024):
        parts = keep(segments(dealt, segment), "parts")
    keep.drop("marked")
    several = parts.filter("NOT whole")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    return parts.filter("whole").select("conv_id", gaps, *COUNTS, "cost", "audit", "repaired").unionByName(joined(several, chained(several)))
