"""Token counts of documents from counts of their pre-tokens, without ids.

The tokens of a text are those of its pre-tokens, each encoded by itself, so a document's number is a sum over its distinct
pre-tokens of frequency times tokens. The first pass gathers all distinct pre-tokens of the corpus and merges each of them once. The
second takes every document's pre-token frequencies. The most frequent pre-tokens (at most FREQUENT, chosen by a histogram of
the counts) are joined by broadcast, so no hot key shuffles; the frequencies of the rest meet the table of pre-tokens by hash buckets
and are summed for each document. What shuffles is packed: a task's rows for a bucket are one compressed row.

Texts are cut at single spaces between visible characters first, where a pre-token always begins, and a task works out the
pre-tokens of each distinct chunk once for megabytes of text.

Cases: null text is empty and has no bytes and no tokens; the special token's string in a text is one token, as the library
has it by default; pre-tokens of any length are merged exactly, long ones by a heap; rows that repeat, also with the same id, are each
counted; an empty table gives an empty result. Columns of the documents stay, but for those that clash with the added ones
(n_bytes, n_tokens, over_limit), which are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import Written, batches_of, give_back, partitions, text_batches

ADDED = ("n_bytes", "n_tokens", "over_limit")
LIMIT = 1024
FREQUENT, FREQUENT_CHARS = 50_000, 64  # pre-tokens that are joined by broadcast, none of them longer
STEPS = 16  # of the counts' histogram for each doubling
SHARD_BYTES = 8 << 20  # of text that a task takes at once
HELD = 300_000  # distinct pre-tokens that a counting task holds before it passes partial counts on
BUCKETS = 4  # of pre-tokens for each shuffle partition
PACK_ROWS = 50_000  # pre-tokens of an Arrow batch, which are packed together
LONG = 2048  # bytes from which a pre-token is merged by a heap
MERGE_ROWS = 20_000  # pre-tokens of an Arrow batch, which are merged together

MARKS = frozenset(".,;:!?")

# Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary, with Unicode's white space.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


class Vocabulary(bpe.Vocabulary):
    """A byte-level vocabulary without normaliser and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids, self.suffix, self.chars = spec["model"]["vocab"], "", bpe.byte_chars()
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}

    def count_long(self, piece: str) -> int:
        """Tokens of one piece: pairs wait in a heap by rank and place, and parts are a linked list."""
        parts: list[str | None] = [self.chars[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, left, after = len(parts), list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        waiting = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue  # one of its sides has been merged since
            parts[i], parts[j], after[i] = a + b, None, after[j]
            n -= 1
            if after[i] < len(parts):
                left[after[i]] = i
            for x, y in ((left[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(waiting, (r, x, parts[x], parts[y]))
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        short = [p for p in pieces if len(p) * 4 <= LONG]
        found = dict(zip(short, map(len, self.merge_all(short)), strict=True)) if short else {}
        return [found[p] if p in found else self.count_long(p) for p in pieces]


# Bytes of a text: white space or a lead byte that could be its, the space, marks, ASCII letters and digits, line feed, other visible ASCII.
_WHITE, _LEAD, _BLANK, _MARK, _PLAIN, _LINE, _SIGN = (1 << k for k in range(7))
_KIND = np.zeros(256, np.uint8)
_KIND[:33] = _WHITE
_KIND[33:127] = _SIGN
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _WHITE | _LEAD
_KIND[32], _KIND[10] = _WHITE | _BLANK, _WHITE | _LINE
_KIND[list(b".,;:!?")] = _MARK | _SIGN
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _PLAIN | _SIGN


class Pieces:
    """The pre-tokens of a chunk, and how many special tokens it holds."""

    def __init__(self, special: list[str]):
        self.marks = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special = special
        self.pattern = regex.compile(PATTERN)

    def __call__(self, chunk: str) -> tuple[list[str], int]:
        body = chunk[1:] if chunk[:1] == " " else chunk
        # most chunks are a word or a mark: no need of the pattern. Letters of later blocks differ by Unicode's version
        if body.isalpha() and (body.isascii() or max(body) < "\u0250") or chunk in MARKS:
            return [chunk], 0
        if self.marks is None or not any(s in chunk for s in self.special):
            return self.pattern.findall(chunk), 0
        parts = self.marks.split(chunk)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks, each chunk's number in order, where each text's chunks begin, with their total) of texts without nulls.

    A text is cut before a space that stands alone between two visible characters: a pre-token begins there whatever comes before.
    So it does between an ASCII letter or digit and a mark, and on both sides of a line feed between two visible ASCII characters.
    Characters whose lead byte could be that of white space count as such, which only makes chunks longer.
    """
    raw, offsets = bpe.buffers_of(texts)
    kind = _KIND[raw]
    first = np.zeros(len(raw), bool)
    if len(raw) > 2:
        white, lead = (kind & _WHITE) > 0, (kind & _LEAD) > 0
        first[1:-1] = ((kind[1:-1] & _BLANK) > 0) & ~(white[:-2] | white[2:])
        first[2:] &= ~lead[:-2]
        first[3:] &= ~lead[:-3]
        line = np.flatnonzero((kind[1:-1] & _LINE) > 0) + 1
        line = line[(kind[line - 1] & kind[line + 1] & _SIGN) > 0]
        first[line] = first[line + 1] = True
    if len(raw) > 1:
        first[1:] |= ((kind[1:] ^ kind[:-1]) == (_MARK | _PLAIN))
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    # a text's first byte is a chunk's first even where it is no space
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw.tobytes())])
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets)


def in_shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], pa.Array]]:
    """Batches until they hold SHARD_BYTES of text, and their texts, nulls as empty ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= SHARD_BYTES:
            yield held, _texts(held, column)
            held, size = [], 0
    if held:
        yield held, _texts(held, column)


def _texts(held: list[pa.RecordBatch], column: int) -> pa.Array:
    return pa.concat_arrays([b.column(column).cast(pa.large_string()) for b in held]).fill_null("")


@functools.lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def packed(names: list[bytes], *columns: np.ndarray) -> bytes:
    """Names and columns of integers, compressed: with what goes from task to task, most rows share their names with others of the task."""
    head = np.array([len(names), *map(len, columns)], np.int64)
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    data = b"".join([len(columns).to_bytes(1, "little"), head.tobytes(), *(c.astype(np.int64).tobytes() for c in (lengths, *columns)), *names])
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    data = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = data[0]
    sizes = np.frombuffer(data, np.int64, n + 1, 1).tolist()
    at, columns = 1 + 8 * (n + 1), []
    for size in sizes:
        columns.append(np.frombuffer(data, np.int64, size, at))
        at += 8 * size
    ends = (np.cumsum(columns[0]) + at).tolist()
    return [data[a:b] for a, b in zip([at, *ends], ends)], columns[1:]


def bucket_of(names: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(names: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its names' places in order of their bytes)."""
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    own = bucket_of(names, buckets)[order]
    order = order[np.argsort(own, kind="stable")]
    own = np.sort(own)
    for part in np.split(order, np.flatnonzero(np.diff(own)) + 1) if len(own) else ():
        yield int(bucket_of([names[part[0]]], buckets)[0]), part


def piece_tokens(docs: DataFrame, path: str, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, piece, n, tokens): all pre-tokens of the documents, how often they occur, and each one's tokens, merged once."""
    special = special_tokens(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = Pieces(special), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            names, n = [p.encode("utf-8", "surrogatepass") for p in held], np.fromiter(held.values(), np.int64, len(held))
            for bucket, part in by_bucket(names, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed([names[i] for i in part], n[part])], pa.binary())], ["bucket", "blob"])
            held.clear()

        for _, texts in in_shards(batches, 0):
            distinct, index, _ = chunks(texts)
            for chunk, n in zip(distinct.to_pylist(), np.bincount(index, minlength=len(distinct)).tolist(), strict=True):
                for p in pieces(chunk.decode("utf-8", "surrogatepass"))[0]:
                    held[p] += n
            if len(held) > HELD:
                yield from flush()
        yield from flush()
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, (n,) = unpacked(blob)
                own = found.setdefault(bucket, Counter())
                for name, k in zip(names, n.tolist(), strict=True):
                    own[name] += k
        vocabulary = _vocabulary(path)
        for bucket, own in found.items():
            names = list(own)
            for at in range(0, len(names), MERGE_ROWS):
                texts = [x.decode("utf-8", "surrogatepass") for x in names[at : at + MERGE_ROWS]]
                columns = [pa.array([bucket] * len(texts), pa.int32()), pa.array(texts, pa.string()), pa.array([own[x] for x in names[at : at + MERGE_ROWS]], pa.int64()), pa.array(vocabulary.counts(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "piece", "n", "tokens"])
        give_back()

    text_batches(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(count, "bucket int, blob binary")
    return parts.repartition(partitions(docs.sparkSession), "bucket").mapInArrow(merge, "bucket int, piece string, n long, tokens long")


def most_frequent(pieces: DataFrame, most: int = FREQUENT) -> dict[str, int]:
    """At most `most` pre-tokens with their tokens: all from the lowest count on that leaves so few, by a histogram."""
    stepped = pieces.filter(F.length("piece") <= FREQUENT_CHARS).withColumn("step", F.floor(F.log2("n") * STEPS))
    least, room = None, most
    for r in stepped.groupBy("step").count().orderBy(F.desc("step")).collect():  # a thousand rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return {r["piece"]: r["tokens"] for r in stepped.filter(F.col("step") >= least).select("piece", "tokens").collect()} if least is not None else {}


def frequencies(docs: DataFrame, path: str, frequent: dict[str, int], buckets: int, text_col: str = "text") -> DataFrame:
    """A row for each document: its columns but the text, _src and _at (a name of its own), n_bytes and _known, the tokens of its frequent pre-tokens and special tokens.

    Besides, rows with _bucket and _blob set, which hold the frequencies of all other pre-tokens of many documents.
    """
    special, known = special_tokens(path), docs.sparkSession.sparkContext.broadcast(frequent)
    kept = [c for c in docs.columns if c != text_col]
    own = {"_src": "int", "_at": "long", "_bytes": "long", "_known": "long", "_bucket": "int", "_blob": "binary"}
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {v}" for k, v in own.items())])
    of_text = docs.columns.index(text_col)
    kinds = dict(zip(own, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens, source, at = Pieces(special), known.value, TaskContext.get().partitionId(), 0
        for held, texts in in_shards(batches, of_text):
            distinct, index, begins = chunks(texts)
            total, rare, numbers = np.zeros(len(distinct) + 1, np.int64), [], {}
            ends = np.zeros(len(distinct) + 1, np.int64)
            for u, chunk in enumerate(distinct.to_pylist()):
                names, n = pieces(chunk.decode("utf-8", "surrogatepass"))
                for p in names:
                    t = tokens.get(p)
                    if t is None:
                        rare.append(numbers.setdefault(p, len(numbers)))
                    else:
                        n += t
                total[u], ends[u + 1] = n, len(rare)
            sums = np.concatenate([[0], np.cumsum(total[index])])
            # (document, rare pre-token, frequency)
            doc = np.repeat(np.arange(len(texts)), np.diff(begins))
            some = np.diff(ends)[index] > 0
            pair, k = np.unique(doc[some] * max(1, len(distinct)) + index[some], return_counts=True)
            doc, u = pair // max(1, len(distinct)), pair % max(1, len(distinct))
            size = np.diff(ends)[u]
            flat = np.repeat(ends[u], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            name, doc, k = np.array(rare, np.int64)[flat], np.repeat(doc, size) + at, np.repeat(k, size)
            order = np.lexsort((doc, name))
            name, doc, k = name[order], doc[order], k[order]
            first = np.searchsorted(name, np.arange(len(numbers) + 1))
            sizes = pc.binary_length(texts).to_numpy()
            row = 0
            for batch in held:
                n = batch.num_rows
                made = [c for i, c in enumerate(batch.columns) if i != of_text]
                made += [pa.array([source] * n, kinds["_src"]), pa.array(np.arange(at + row, at + row + n)), pa.array(sizes[row : row + n], pa.int64()), pa.array(sums[begins[row + 1 : row + n + 1]] - sums[begins[row : row + n]])]
                made += [pa.nulls(n, kinds["_bucket"]), pa.nulls(n, kinds["_blob"])]
                yield pa.RecordBatch.from_arrays(made, [*kept, *own])
                row += n
            words = [p.encode("utf-8", "surrogatepass") for p in numbers]
            kinds_of = {f.name: f.type for f in held[0].schema}
            for bucket, part in by_bucket(words, buckets):
                length = first[part + 1] - first[part]
                take = np.repeat(first[part], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                blob = packed([words[i] for i in part], length, doc[take], k[take])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kinds_of[c]) for c in kept), *(pa.array([v], kinds[c]) for c, v in zip(own, (source, None, None, None, bucket, blob), strict=True))], [*kept, *own])
            at += len(texts)
        give_back()

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def looked_up(rare: DataFrame, pieces: DataFrame, buckets: int) -> DataFrame:
    """(_src, _at, _more): the tokens of each document's other pre-tokens, by joining their frequencies with the table of pre-tokens, bucket by bucket, and summing for each document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pydict()
            names, tokens = [p.encode("utf-8", "surrogatepass") for p in own["piece"]], np.array(own["tokens"], np.int64)
            for bucket, part in by_bucket(names, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed([names[i] for i in part], tokens[part])], pa.binary())], ["_bucket", "_blob"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens: dict[bytes, int] = {}
        for blob in right.column("_blob").to_pylist():
            names, (n,) = unpacked(blob)
            tokens.update(zip(names, n.tolist(), strict=True))
        out: dict[int, list] = {}
        for source, blob in zip(left.column("_src").to_pylist(), left.column("_blob").to_pylist(), strict=True):
            names, (length, doc, k) = unpacked(blob)
            out.setdefault(source, []).append((doc, k * np.repeat(np.fromiter((tokens[x] for x in names), np.int64, len(names)), length)))
        made = [(source, packed([], *by_doc(np.concatenate([d for d, _ in own]), np.concatenate([n for _, n in own])))) for source, own in out.items()]
        return pa.table({"_src": pa.array([s for s, _ in made], pa.int32()), "_blob": pa.array([b for _, b in made], pa.binary())})

    def by_doc(doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(doc, return_inverse=True)
        out = np.zeros(len(own), np.int64)
        np.add.at(out, at, n)
        return own, out

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for source, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, (doc, n) = unpacked(blob)
                if source in found:
                    doc, n = np.concatenate([found[source][0], doc]), np.concatenate([found[source][1], n])
                found[source] = by_doc(doc, n)
        for source, (doc, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(doc), pa.int32()), pa.array(doc), pa.array(n)], ["_src", "_at", "_more"])
        give_back()

    table = pieces.select("piece", "tokens").mapInArrow(pack, "_bucket int, _blob binary")
    both = rare.groupBy("_bucket").cogroup(table.groupBy("_bucket")).applyInArrow(join, "_src int, _blob binary")
    return both.repartition(partitions(rare.sparkSession), "_src").mapInArrow(total, "_src int, _at long, _more long")


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """The documents' columns but the text, with n_bytes, n_tokens and over_limit."""
    docs = docs.select(*(c for c in docs.columns if c == text_col or c not in ADDED))
    kept = [c for c in docs.columns if c != text_col]
    keep, buckets = Written(spark, "tokens"), BUCKETS * partitions(spark)
    pieces = keep(piece_tokens(docs, path, buckets, text_col), "pieces")
    rows = keep(frequencies(docs, path, most_frequent(pieces, frequent), buckets, text_col), "rows")  # written, so a document's name stays
    with batches_of(spark, PACK_ROWS):
        sums = keep(looked_up(rows.filter("_bucket IS NOT NULL").select("_bucket", "_src", "_blob"), pieces, buckets), "sums")
    keep.drop("pieces")
    total = F.col("_known") + F.coalesce(F.col("_more"), F.lit(0))
    out = rows.filter("_bucket IS NULL").drop("_bucket", "_blob").join(sums, ["_src", "_at"], "left")
    return out.select(*kept, F.col("_bytes").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit"))
