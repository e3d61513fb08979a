"""Phrase collocations from weighted acyclic automata.

Every position of a text gives one window: its word and those that follow in the same piece. A shard (some megabytes of one
language's texts) sorts its windows and compiles them into a count transducer: a minimal acyclic automaton over words, all of whose
paths have the same length (ended windows are padded), with a weight for each path in sorted order. How often a phrase occurs is the
sum of the weights below it. Words are ordered by a hash, so a phrase's windows lie in one interval of keys. Quantiles of all shards'
keys cut the keys into prefix ranges of even size, even where one word or one pair of words starts a third of all windows; each shard
cuts its transducer at them, and a range unites what it gets and sums equal paths' weights. A phrase whose interval lies in one range
is complete there and dropped if it is rarer than asked; those that reach over a border are summed over ranges.

Two rounds keep the windows few, exactly: a phrase can't be more frequent than the pairs of words in it. The first round counts words
and pairs. A Bloom filter of the frequent pairs, made from all counts, then cuts the windows of the second, which counts three to five
words. False positives of the filter cost time and never change a count.

Parts of phrases are looked up by composition: requests and counted phrases meet by a hash, the phrases as a transducer, which all
requests walk together.

Cases: null and empty texts have no words; a null language is `und`; texts are read whole, whatever their length; repeated rows
count each; an empty table gives an empty result; only the text and language columns are read, so no other column can clash. Ties
in a language's list go by descending count, then by the phrase's bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, batches_of, give_back, partitions, text_batches

LEAST, WORDS, TOP = 100, 5, 2000
NO_LANG = "und"
SHARD_CHARS = 8 << 20  # of text that a task compiles at once
RANGE_WINDOWS = 2_000_000  # paths that meet in a range
MARK_EVERY = 4096  # windows that a mark of the key distribution stands for
# Bits that each word's hash has in a window's key of 63 bits, by the longest window.
KEY_BITS = {2: (32, 31), 5: (16, 16, 12, 10, 9)}
FILTER_BITS, FILTER_LOG2 = 16, (16, 30)  # of the pair filter: for each pair, and at least and at most in all
FRAGMENT = 16  # log2 of the bits in one fragment of the filter

# Bytes that end a piece, and the byte that parts words.
BREAKS, BLANK = b".,;:!?\x0a\x0b\x0c\x0d", 0x20


def _folded() -> np.ndarray:
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[np.frombuffer(BREAKS, np.uint8)] = 10
    to[9] = BLANK
    return to


FOLDED = _folded()


class Alphabet:
    """Distinct words of one language in the order of their hashes, then of their bytes."""

    def __init__(self, words: pa.Array, lang: str):
        seed = xxhash.xxh64_intdigest(lang.encode())
        own = words.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), np.uint64, len(own))
        order = np.argsort(hashes, kind="stable")
        if len(order) > 1 and (np.diff(hashes[order]) == 0).any():
            order = np.array(sorted(range(len(own)), key=lambda i: (int(hashes[i]), own[i])), np.int64)
        self.words, self.hashes = words.take(pa.array(order)), hashes[order]
        self.place = np.empty(len(order), np.int64)  # of each given word, from 1; 0 ends a window
        self.place[order] = np.arange(1, len(order) + 1)


def binary(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def read_words(texts: list[str], lang: str) -> tuple[Alphabet, np.ndarray, np.ndarray]:
    """(alphabet, each position's word, each position's piece) of folded texts."""
    raw = FOLDED[np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)]
    inner = (raw != BLANK) & (raw != 10)
    edges = np.flatnonzero(np.diff(inner.view(np.int8), prepend=0, append=0))
    begin, length = edges[::2], edges[1::2] - edges[::2]
    coded = binary(length, raw[inner]).dictionary_encode()
    alphabet = Alphabet(coded.dictionary, lang)
    return alphabet, alphabet.place[coded.indices.to_numpy()], np.cumsum(raw == 10)[begin]


def windows(word: np.ndarray, piece: np.ndarray, size: int, joined: np.ndarray | None = None) -> np.ndarray:
    """A row for each position: its word and the next ones of the same piece, 0 after the end. joined: whether a position and the next one may stand in a window."""
    n = len(word)
    out = np.zeros((n, size), np.int64)
    out[:, 0] = word
    live = np.ones(n, bool)
    for d in range(1, min(size, n)):
        live = live[: n - d] & (piece[d:] == piece[: n - d])
        if joined is not None:
            live &= joined[d - 1 : n - 1]
        out[: n - d, d] = np.where(live, word[d:], 0)
    return out


def packed(rows: np.ndarray, symbols: int) -> list[np.ndarray]:
    """Rows of symbols as few integers with the same order, the first of them the most significant."""
    bits = max(1, int(symbols).bit_length())
    each, out = 63 // bits, []
    for at in range(0, rows.shape[1], each):
        made = np.zeros(len(rows), np.int64)
        for d in range(at, min(at + each, rows.shape[1])):
            made = made << bits | rows[:, d]
        out.append(made)
    return out


def summed(rows: np.ndarray, weights: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with their weights' sums."""
    keys = packed(rows, symbols)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.ones(len(rows), bool)
    fresh[1:] = False
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(fresh)
    return rows[order[at]], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def prefixes(rows: np.ndarray) -> list[np.ndarray]:
    """For each length d from 0: where a new prefix of d words begins in sorted rows."""
    fresh, out = np.zeros(len(rows), bool), []
    fresh[:1] = True
    out.append(np.flatnonzero(fresh))
    for d in range(rows.shape[1]):
        fresh = fresh.copy()
        fresh[1:] |= rows[1:, d] != rows[:-1, d]
        out.append(np.flatnonzero(fresh))
    return out


class Transducer:
    """A minimal acyclic automaton whose paths are the rows, and a weight for each path in order.

    levels[d] = (edges of each state, their symbols, their target states of level d + 1). States with equal edges are one.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray):
        self.levels, self.weights = levels, weights

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray) -> Transducer:
        """From sorted distinct rows: a state can't change any more once its prefix is passed, so levels are settled from the ends on."""
        begins = prefixes(rows)
        below, levels = np.zeros(len(rows), np.int64), []
        for d in range(rows.shape[1] - 1, -1, -1):
            states, edges = begins[d], begins[d + 1]
            symbol, first = rows[edges, d], np.searchsorted(edges, states)
            degree = np.diff(first, append=len(edges))
            slot = np.arange(len(edges)) - np.repeat(first, degree)
            with np.errstate(over="ignore"):
                mixed = (symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ below.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) + slot.astype(np.uint64)
                mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                sign = np.add.reduceat(mixed ^ mixed >> np.uint64(32), first) if len(first) else mixed[:0]
            _, model, same = np.unique(sign, return_index=True, return_inverse=True)
            # equal hashes are held against the state that stands for them; one that differs stays a state of its own
            twin = model[same]
            differs = degree != degree[twin]
            copy = np.repeat(first[twin], degree) + np.minimum(slot, np.repeat(degree[twin], degree) - 1)
            if len(first):
                differs |= np.logical_or.reduceat((symbol != symbol[copy]) | (below != below[copy]), first)
            if differs.any():
                same = same.copy()
                same[differs] = len(model) + np.arange(differs.sum())
                model = np.concatenate([model, np.flatnonzero(differs)])
            take = np.repeat(first[model], degree[model]) + np.arange(degree[model].sum()) - np.repeat(np.cumsum(degree[model]) - degree[model], degree[model])
            levels.append((degree[model], symbol[take], below[take]))
            below = same
        return cls(levels[::-1], weights)

    def rows(self) -> np.ndarray:
        """All paths, in order."""
        state, columns = np.zeros(1 if len(self.weights) else 0, np.int64), []
        for degree, symbol, target in self.levels:
            n, starts = degree[state], np.cumsum(degree) - degree
            at = np.repeat(starts[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = [np.repeat(c, n) for c in columns] + [symbol[at]]
            state = target[at]
        return np.stack(columns, 1)

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        """The weight of each row's path, 0 where there is none. All rows walk together, a symbol a step; edges' paths before a path number it."""
        below = np.ones(1, np.int64)
        sums = []
        for degree, _, target in reversed(self.levels):
            paths = below[target]
            sums.append(np.cumsum(paths) - paths)
            below = np.add.reduceat(paths, np.cumsum(degree) - degree) if len(degree) else np.zeros(1, np.int64)
        state, number, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        if not len(self.weights):
            return number
        for d, ((degree, symbol, target), before) in enumerate(zip(self.levels, sums[::-1], strict=True)):
            starts, most = np.cumsum(degree) - degree, int(symbol.max()) + 1
            keys = np.repeat(np.arange(len(degree)), degree) * most + symbol
            want = np.where(rows[:, d] < most, state * most + rows[:, d], -1)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            live &= keys[at] == want
            at[~live] = 0
            number += np.where(live, before[at] - before[starts[state]], 0)
            state = np.where(live, target[at], 0)
        return np.where(live, self.weights[np.minimum(number, len(self.weights) - 1)], 0)

    def dump(self, words: pa.Array) -> bytes:
        """With the words that occur, renumbered, so that a cut has no more of them than it needs."""
        used = np.unique(np.concatenate([s for _, s, _ in self.levels]))
        used = used[used > 0]
        own = words.take(pa.array(used - 1))
        numbers = [np.array([len(self.levels), len(own), len(self.weights)])]
        for degree, symbol, target in self.levels:
            numbers += [np.array([len(degree), len(symbol)]), degree, np.searchsorted(used, symbol) + (symbol > 0), target]
        flat = np.concatenate([*numbers, self.weights, pc.binary_length(own).to_numpy()])
        wide = np.int32 if not len(flat) or flat.max() < 1 << 31 else np.int64
        data = b"".join([bytes([wide().itemsize]), len(flat).to_bytes(8, "little"), flat.astype(wide).tobytes(), *own.to_pylist()])
        return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)

    @classmethod
    def load(cls, blob: bytes) -> tuple[Transducer, pa.Array]:
        data = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        kind, n = np.int32 if data[0] == 4 else np.int64, int.from_bytes(data[1:9], "little")
        flat = np.frombuffer(data, kind, n, 9).astype(np.int64)
        depth, words, paths = flat[:3].tolist()
        at, levels = 3, []
        for _ in range(depth):
            states, edges = flat[at : at + 2].tolist()
            ends = np.cumsum([at + 2, states, edges, edges])
            levels.append(tuple(flat[a:b] for a, b in zip(ends, ends[1:])))
            at = int(ends[-1])
        weights, lengths = flat[at : at + paths], flat[at + paths : at + paths + words]
        return cls(levels, weights), binary(lengths, data[9 + n * kind().itemsize :])


def keys_of(rows: np.ndarray, hashes: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Where each row lies among all windows."""
    tops, out = np.concatenate([np.zeros(1, np.uint64), hashes]), np.zeros(len(rows), np.int64)
    for d, b in enumerate(bits):
        out = out << b | (tops[rows[:, d]] >> np.uint64(64 - b)).astype(np.int64)
    return out


def pair_slots(left: np.ndarray, right: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each pair of words' hashes."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ right >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
    mask = np.uint64((1 << log2) - 1)
    return (x & mask).astype(np.int64), (x >> np.uint64(32) & mask).astype(np.int64)


def shards(docs: DataFrame, size: int, pairs=None, log2: int = 0) -> DataFrame:
    """(lang, windows, marks, blob): a transducer for each shard. pairs: the broadcast filter of pairs, for windows of three words and more."""
    bits = KEY_BITS[size]

    def compiled(lang: str, texts: list[str]) -> Iterator[tuple]:
        alphabet, word, piece = read_words(texts, lang)
        if not len(word):
            return
        if pairs is None:
            rows = windows(word, piece, size)
        else:
            a, b = pair_slots(alphabet.hashes[word[:-1] - 1], alphabet.hashes[word[1:] - 1], log2)
            filled = np.frombuffer(pairs.value, np.uint8)
            joined = np.append((filled[a >> 3] >> (a & 7) & 1 & filled[b >> 3] >> (b & 7)).astype(bool), False)
            rows = windows(word, piece, size, joined)
            rows = rows[rows[:, 2] > 0]
            if not len(rows):
                return
        rows, weights = summed(rows, np.ones(len(rows), np.int64), len(alphabet.hashes))
        marks = np.sort(keys_of(rows, alphabet.hashes, bits))[MARK_EVERY // 2 % len(rows) :: MARK_EVERY]
        yield lang, len(rows), marks, Transducer.build(rows, weights).dump(alphabet.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for made in compiled(lang, texts):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["lang", "windows", "marks", "blob"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    chars += len(text)
                    if chars >= SHARD_CHARS:
                        yield from flush()
                        chars = 0
        yield from flush()
        give_back()

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, windows long, marks array<long>, blob binary")


def borders(spark: SparkSession, made: DataFrame) -> np.ndarray:
    """Keys that cut all windows into ranges of about RANGE_WINDOWS paths: one number for each range."""
    total = made.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(partitions(spark), math.ceil(total / RANGE_WINDOWS))
    if ranges < 2 or not total:
        return np.zeros(0, np.int64)
    cuts = made.select(F.explode("marks").alias("mark")).agg(F.percentile_approx("mark", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("cuts")).first()["cuts"]
    return np.unique(np.array(cuts or [], np.int64))


def united(made: DataFrame, cuts: np.ndarray, size: int, shortest: int, least: int) -> DataFrame:
    """(lang, phrase, words, n): phrases of `shortest` words and more that occur `least` times, from all shards; of no words: how many windows there are."""
    bits = KEY_BITS[size]
    total_bits = sum(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, words = Transducer.load(blob)
                rows = whole.rows()
                alphabet = Alphabet(words, lang)  # as it was: in order already
                place = np.searchsorted(cuts, keys_of(rows, alphabet.hashes, bits), side="right")
                for r in np.unique(place).tolist():
                    own = place == r
                    part = Transducer.build(rows[own], whole.weights[own]).dump(words)
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([lang], pa.string()), pa.array([part], pa.binary())], ["range", "lang", "blob"])
        give_back()

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        out = {"lang": [], "phrase": [], "words": [], "n": []}
        blobs: dict[str, list[bytes]] = {}
        for lang, blob in zip(table.column("lang").to_pylist(), table.column("blob").to_pylist(), strict=True):
            blobs.setdefault(lang, []).append(blob)
        for lang, own in blobs.items():
            parts = [Transducer.load(b) for b in own]
            coded = pa.concat_arrays([w for _, w in parts]).dictionary_encode()
            alphabet = Alphabet(coded.dictionary, lang)
            place, rows, at = np.concatenate([[0], alphabet.place[coded.indices.to_numpy()]]), [], 0
            for part, words in parts:
                given = part.rows()
                rows.append(place[np.where(given > 0, given + at, 0)])
                at += len(words)
            rows, weights = summed(np.concatenate(rows), np.concatenate([p.weights for p, _ in parts]), len(alphabet.hashes))
            begins, low = prefixes(rows), keys_of(rows, alphabet.hashes, bits)
            for d in range(0, size + 1):
                if d and d < shortest:
                    continue
                at = begins[d]
                n = np.add.reduceat(weights, at)
                rest = total_bits - sum(bits[:d])
                first = low[at] >> rest << rest
                over = np.searchsorted(cuts, first, side="right") != np.searchsorted(cuts, first | (1 << rest) - 1, side="right")
                keep = (n >= least) | over if d else np.ones(len(at), bool)
                if d:
                    keep &= rows[at, d - 1] > 0
                at, n = at[keep], n[keep]
                found = alphabet.words.take(pa.array(rows[at, :d].ravel() - 1)).to_pylist()
                out["phrase"] += [b" ".join(found[i * d : i * d + d]).decode("utf-8", "surrogatepass") for i in range(len(at))]
                out["lang"] += [lang] * len(at)
                out["words"] += [d] * len(at)
                out["n"] += n.tolist()
        give_back()
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "phrase": pa.array(out["phrase"], pa.string()), "words": pa.array(out["words"], pa.int32()), "n": pa.array(out["n"], pa.int64())})

    pieces = made.select("lang", "blob").mapInArrow(cut, "range int, lang string, blob binary")
    found = pieces.groupBy("range").applyInArrow(unite, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))


def pair_filter(frequent: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the pairs of words: fragments are made by tasks, and the driver puts them together, FILTER_BITS a pair and 128 MB at most."""
    pairs = frequent.filter("words = 2")
    log2 = min(max(math.ceil(math.log2(max(1, pairs.count() * FILTER_BITS))), FILTER_LOG2[0]), FILTER_LOG2[1])

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seeds = [xxhash.xxh64_intdigest(x.encode()) for x in frame["lang"]]
            sides = [np.array([xxhash.xxh64_intdigest(p.split(" ")[side].encode("utf-8", "surrogatepass"), s) for p, s in zip(frame["phrase"], seeds)], np.uint64) for side in (0, 1)]
            yield pd.DataFrame({"slot": np.concatenate(pair_slots(*sides, log2))})

    def fragment(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        filled = np.zeros(1 << FRAGMENT, np.uint8)
        filled[frame["slot"].to_numpy() & (1 << FRAGMENT) - 1] = 1
        return pd.DataFrame({"fragment": [key[0]], "bits": [np.packbits(filled, bitorder="little").tobytes()]})

    found = pairs.select("lang", "phrase").mapInPandas(slots, "slot long").distinct()
    own = found.groupBy(F.shiftright("slot", FRAGMENT).cast("int").alias("fragment")).applyInPandas(fragment, "fragment int, bits binary")
    out = np.zeros((1 << log2) >> 3, np.uint8)
    each = 1 << FRAGMENT >> 3
    for r in own.toLocalIterator():
        out[r["fragment"] * each : (r["fragment"] + 1) * each] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes(), log2


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, n): all phrases of one to five words that occur `least` times; with words = 0, each language's words in all."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    keep = Written(spark, "phrases")
    made = keep(shards(own, 2), "shards2")
    with batches_of(spark, 4):  # transducers of megabytes
        short = keep(united(made, borders(spark, made), 2, 1, least), "short")
    keep.drop("shards2")
    bits, log2 = pair_filter(short)
    made = keep(shards(own, WORDS, spark.sparkContext.broadcast(bits), log2), "shards5")
    with batches_of(spark, 4):
        long = keep(united(made, borders(spark, made), WORDS, 3, least).filter("words > 0"), "long")
    keep.drop("shards5")
    return short.unionByName(long)


def part_counts(spark: SparkSession, counted: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, phrase, n) of the asked phrases, by composing them with the transducer of the counted ones that have the same hash bucket."""
    n = partitions(spark)
    both = counted.select("lang", "phrase", "n").unionByName(asked.select("lang", "phrase", F.lit(None).cast("long").alias("n")).distinct())
    both = both.withColumn("bucket", F.pmod(F.xxhash64("lang", "phrase"), F.lit(n)).cast("int"))

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            split = [p.encode("utf-8", "surrogatepass").split(b" ") for p in own.column("phrase").to_pylist()]
            sizes = np.array([len(s) for s in split])
            coded = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode()
            alphabet = Alphabet(coded.dictionary, lang)
            rows = np.zeros((len(split), WORDS), np.int64)
            rows[np.arange(WORDS) < sizes[:, None]] = alphabet.place[coded.indices.to_numpy()]
            n = own.column("n")
            is_count = pc.is_valid(n).to_numpy()
            counts, weights = summed(rows[is_count], n.filter(pc.is_valid(n)).to_numpy(), len(alphabet.hashes))
            phrases = own.column("phrase").filter(pa.array(~is_count))
            got = Transducer.build(counts, weights).weigh(rows[~is_count]) if len(counts) else np.zeros((~is_count).sum(), np.int64)
            out.append(pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": phrases.combine_chunks().cast(pa.string()), "n": pa.array(got, pa.int64())}))
        return pa.concat_tables(out)

    return both.groupBy("bucket").applyInArrow(compose, "lang string, phrase string, n long")


def part(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to five words, scored by their worst cut, without those that a longer phrase always holds."""
    counted = Written(spark, "phrases")(frequent_phrases(spark, docs, least, text_col, lang_col), "counted")
    totals = counted.filter("words = 0").select("lang", F.col("n").alias("total"))
    phrases = counted.filter("words > 0")
    words = F.split("phrase", " ")
    cuts = counted.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("*", part(words, F.lit(1), F.col("k")).alias("left"), part(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    asked = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase"))
    parts = Written(spark, "phrases")(part_counts(spark, phrases, asked), "parts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # what one word less leaves is always in the longer phrase if it occurs as often; longer phrases still then hold it too
    ends = F.explode(F.filter(F.array(F.when(F.col("k") == F.col("words") - 1, F.struct(F.col("left").alias("phrase"), F.col("l").alias("n"))), F.when(F.col("k") == 1, F.struct(F.col("right").alias("phrase"), F.col("r").alias("n")))), lambda x: x.isNotNull()))
    inside = cuts.select("lang", "a", ends.alias("own")).filter("a >= own.n").select("lang", "own.phrase").distinct()
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(F.broadcast(totals), "lang") if totals.count() <= 100_000 else cuts.join(totals, "lang")
    scored = scored.select("lang", "phrase", "a", "k", "l", "r", F.col("total").alias("n"), (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("total")).cast("decimal(38,0)").alias("_up"), (wide("l") * wide("r")).cast("decimal(38,0)").alias("_down"))
    scored = scored.withColumn("score", F.expr("_up div _down"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).join(inside, ["lang", "phrase"], "left_anti")
    flat = worst.select("lang", "phrase", *(F.col(f"w.{c}").alias(c) for c in ("a", "l", "r", "n", "score")))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return flat.withColumn("rank", best).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
