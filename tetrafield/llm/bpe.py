"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus (counted over all documents) are compiled with their id sequences into a minimal acyclic
automaton that shares prefixes and suffixes; numeric outputs on its edges add up to a word's number, which points into
one table of ids. The automaton is a flat file that Spark ships to every executor and that workers memory-map. Words it
lacks are merged exactly by rank. The lexicon affects only speed, never ids.

Cases: null text counts as empty and gives no ids; special tokens written in a text become their single id, as the
tokenizers library does; an empty table gives an empty result; texts are encoded whole, whatever their length; rows
that repeat are each encoded. Input columns that clash with the added ones (ids, n_tokens, decoded) are replaced.
"""

from __future__ import annotations

import atexit
import functools
import json
import os
import shutil
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, give_back, text_batches

ADDED = ("ids", "n_tokens", "decoded")
LEXICON_WORDS = 60_000  # the automaton's size is bounded by this
MEMO_BYTES = 48 << 20  # of a worker's memo, dropped as a whole when full
COUNT_WORDS = 150_000  # distinct words that a counting task holds before it passes partial counts on
STEPS = 16  # of the counts' histogram for each doubling: a thousand rows at most, whatever the corpus
GROUP_BYTES = 4 << 20  # texts are encoded in groups of this size, so that each distinct word of a group is looked up once

# Bytes where texts are cut: white space of one byte falls away, and a piece always ends between an ASCII letter or digit and a mark.
_SPACE, _MARK, _PLAIN = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[list(b".,;:!?")] = _MARK
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _PLAIN


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins, with their end) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each word's number in order, where each text's words begin, with their total) of texts without nulls: cut at white space and marks."""
    raw, offsets = buffers_of(texts)
    kind = _KIND[raw]
    seen = kind != _SPACE
    first = np.ones(len(raw), bool)
    first[1:] = ~seen[:-1] | ((kind[1:] | kind[:-1]) == _MARK | _PLAIN)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    last = np.ones(len(raw), bool)
    last[:-1] = first[1:] | ~seen[1:]
    starts = np.flatnonzero(first & seen)
    ends = np.cumsum(np.flatnonzero(last & seen) - starts + 1)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw[seen].tobytes())])
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets)


class Vocabulary:
    """A byte-level BPE read from a tokenizers file: the pieces of a text, exact merges, and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(spec["model"]["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.tokens = {i: t for t, i in (self.ids | special).items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Unicode's white space; the regex module's \s also has U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.chars = byte_chars()

    def pieces(self, text: str) -> list[str]:
        """Normalised words in order; a special token is a piece of its own, marked by a leading NUL."""
        if self.split is None or not any(s in text for s in self.special):
            return self._pieces(text)
        found: list[str] = []
        for part in self.split.split(text):
            found += ["\0" + part] if part in self.special else self._pieces(part)
        return found

    @functools.cached_property
    def cuttable(self) -> bool:
        """Whether texts may be cut into words first: no special token would be cut."""
        return all(len(distinct_words(pa.array([t]))[1]) == 1 and not _SPACE & np.bitwise_or.reduce(_KIND[list(t.encode())]) for t in self.special)

    def word_pieces(self, word: str) -> list[str]:
        """pieces() of a word: most are letters only and need no pattern."""
        return [word.lower()] if word.isascii() and word.isalpha() else self.pieces(word)

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter: no final sigma
        return self.pattern.findall(text.lower())

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece by applying the lowest-ranked merge, leftmost first, until none applies."""
        if piece[0] == "\0" and piece[1:] in self.special:
            return [self.special[piece[1:]]]
        parts = [self.chars[b] for b in piece.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        ranks, most = self.ranks, len(self.ranks)
        while len(parts) > 1:
            best, at = min((ranks.get(pair, most), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == most:
                break
            left, right = parts[at], parts[at + 1]
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    merged.append(left + right)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return [self.ids[p] for p in parts if p in self.ids]

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """For merging many pieces at once: sorted pair keys with their ranks, the id that each rank makes, and the ids of bytes within and at the end of a piece."""
        size = max(self.tokens) + 1
        pairs = sorted((self.ids[a] * size + self.ids[b], r) for (a, b), r in self.ranks.items())
        made = np.empty(len(self.ranks), np.int64)
        for (a, b), r in self.ranks.items():
            made[r] = self.ids[a + b]
        inner, last = (np.array([self.ids.get(c + e, -1) for c in self.chars]) for e in ("", self.suffix))
        return np.array([k for k, _ in pairs]), np.array([r for _, r in pairs]), made, inner, last

    def merge_all(self, words: list[str]) -> list[np.ndarray]:
        """What merge() gives for each word; all words take a step together, each with its own lowest rank."""
        if (self.tables[3] < 0).any() or (self.tables[4] < 0).any() or any(w[0] == "\0" for w in words):
            return [np.array(self.merge(w), np.int64) for w in words]
        keys, order, made, inner, last = self.tables
        size, none = max(self.tokens) + 1, len(made)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a * size + b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, order[at], none)

        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        count = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        part, ends = inner[flat], np.cumsum(count) - 1
        part[ends] = last[flat[ends]]
        pair = np.full(len(part), none)
        pair[:-1] = rank(part[:-1], part[1:])
        pair[ends] = none
        name, out = np.arange(len(words)), [np.zeros(0, np.int64)] * len(words)
        while len(name):
            starts = np.cumsum(count) - count
            least = np.minimum.reduceat(pair, starts)
            over = least == none
            if over.any():
                for i, a, n in zip(name[over].tolist(), starts[over].tolist(), count[over].tolist(), strict=True):
                    out[i] = part[a : a + n]
                stay = np.repeat(~over, count)
                part, pair, name, count, least = part[stay], pair[stay], name[~over], count[~over], least[~over]
                if not len(name):
                    break
            chosen = pair == np.repeat(least, count)
            # of overlapping pairs (aaa) every second one, from the left
            run = np.flatnonzero(chosen)
            fresh = np.ones(len(run), bool)
            fresh[1:] = np.diff(run) > 1
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            run = run[(np.arange(len(run)) - begin) % 2 == 0]
            part[run] = made[pair[run]]
            stay = np.ones(len(part), bool)
            stay[run + 1] = False
            word = np.repeat(np.arange(len(name)), count)
            count = count - np.bincount(word[run], minlength=len(name))
            pair[run] = pair[run + 1]  # a pair is none where a word ends
            part, pair = part[stay], pair[stay]
            at = run - np.arange(len(run))  # where the merged parts are now
            ends = np.cumsum(count) - 1
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched < len(part) - 1]
            pair[touched] = rank(part[touched], part[touched + 1])
            pair[ends] = none
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens stand apart by a space."""
        return " ".join([self.tokens[i] for i in ids])


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The automaton as bytes: a line of JSON (array names, types, sizes), then the arrays.

    Words come in order of their bytes. A state that can no longer change is looked up among equal ones, so suffixes are shared.
    Edges hold the number of words that their state's earlier branches accept; these numbers sum to a word's index.
    """
    words = sorted((w.encode("utf-8", "surrogatepass"), w) for w in entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the last word: final, edges (byte, state)

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            at = known.setdefault(key, len(states))
            if at == len(states):
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], at)

    last = b""
    for word, _ in words:
        same = len(os.path.commonprefix([word, last]))
        settle(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    settle(0)
    states.append((path[0][0], tuple(path[0][1])))
    below: list[int] = []
    keys, targets, adds = [], [], []
    for s, (final, edges) in enumerate(states):  # targets come before their sources
        n = int(final)
        for b, to in edges:
            keys.append(s << 8 | b)
            targets.append(to)
            adds.append(n)
            n += below[to]
        below.append(n)
    ids = [entries[w] for _, w in words]
    arrays = {
        "keys": np.array(keys, np.uint64), "targets": np.array(targets, np.uint32), "adds": np.array(adds, np.uint32),
        "final": np.array([f for f, _ in states], np.uint8), "offsets": np.cumsum([0, *map(len, ids)]).astype(np.uint64), "ids": np.array([i for x in ids for i in x], np.uint32),
    }
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())


class Lexicon:
    """The memory-mapped automaton."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        raw, at = np.memmap(path, np.uint8, "r"), len(head)
        for name, kind, n in json.loads(head):
            size = np.dtype(kind).itemsize * n
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, or -1: all words walk the automaton together, a byte a step."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        starts = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(raw), np.uint8)
        number = np.zeros(len(raw), np.int64)
        if not len(self.keys):
            return np.full(len(raw), -1, np.int64)
        state = np.full(len(raw), len(self.final) - 1, np.int64)
        live = np.arange(len(raw))
        for step in range(int(size.max(initial=0))):
            more = size[live] > step
            live = live[more]
            if not len(live):
                break
            key = (state[live].astype(np.uint64) << np.uint64(8)) | flat[starts[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            state[live[~there]] = -1
            live, edge = live[there], edge[there]
            number[live] += self.adds[edge]
            state[live] = self.targets[edge]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] == 1), number, -1)

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[int(self.offsets[number]) : int(self.offsets[number + 1])]


class Encoder:
    """Memo before automaton before exact merges, for the distinct words of many texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: str | None = None):
        self.vocabulary = vocabulary
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.forget()
        names = [vocabulary.tokens.get(i) for i in range(max(vocabulary.tokens) + 1)]
        self.spaced = pa.array([None if t is None else " " + t for t in names], pa.large_string())

    def forget(self) -> None:
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    def _learn(self, words: list[bytes]) -> None:
        own = [self.vocabulary.word_pieces(w.decode("utf-8", "surrogatepass")) for w in words]
        pieces = list(dict.fromkeys(p for x in own for p in x))
        numbers = self.lexicon.numbers(pieces) if self.lexicon is not None else np.full(len(pieces), -1)
        unseen = np.flatnonzero(numbers < 0).tolist()
        merged = dict(zip(unseen, self.vocabulary.merge_all([pieces[i] for i in unseen]), strict=True))
        ids = {p: (self.lexicon.ids_of(n) if n >= 0 else merged[i].astype("<u4")).tobytes() for i, (p, n) in enumerate(zip(pieces, numbers.tolist(), strict=True))}
        for word, x in zip(words, own, strict=True):
            made = self.memo[word] = ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x])
            self.held += 170 + len(word) + len(made)  # an entry of a dict and its objects, about

    def columns(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """ids (little-endian unsigned 32-bit integers), n_tokens and decoded of texts without nulls."""
        if self.vocabulary.cuttable:
            words, index, begins = distinct_words(texts)
        else:  # a special token that would be cut: whole texts
            words, index, begins = texts.cast(pa.large_string()).cast(pa.large_binary()), np.arange(len(texts)), np.arange(len(texts) + 1)
        own = words.to_pylist()
        if self.held > MEMO_BYTES:
            self.forget()
        if new := [w for w in own if w not in self.memo]:
            self._learn(list(dict.fromkeys(new)))
        made = pa.array([self.memo[w] for w in own], pa.large_binary()).take(pa.array(index))
        at = np.frombuffer(made.buffers()[1], np.int64, len(index) + 1)[begins] if len(index) else np.zeros(len(texts) + 1, np.int64)
        flat = np.frombuffer(made.buffers()[2] or b"", "<u4", int(at[-1]) // 4)
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(flat)])
        # the decoded text: each token after a space, then without a text's first space
        spaced = self.spaced.take(pa.array(flat))
        ends = np.frombuffer(spaced.buffers()[1], np.int64, len(flat) + 1)[at // 4] if len(flat) else np.zeros(len(texts) + 1, np.int64)
        some = np.diff(ends) > 0
        data = np.delete(np.frombuffer(spaced.buffers()[2] or b"", np.uint8, int(ends[-1])), ends[:-1][some])
        ends = ends - np.concatenate([[0], np.cumsum(some)])
        decoded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data))
        return ids.cast(pa.binary()), pa.array(np.diff(at) // 4), decoded.cast(pa.string())

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, their decoded text) of each text."""
        ids, _, decoded = self.columns(pa.array(texts, pa.large_string()))
        return list(zip(ids.to_pylist(), decoded.to_pylist(), strict=True))

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_all([text])[0]


@functools.lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    """A worker's one copy, for counting and encoding."""
    return Vocabulary(path)


@functools.lru_cache(1)
def _encoder(path: str, lexicon: str | None) -> Encoder:
    return Encoder(_vocabulary(path), SparkFiles.get(lexicon) if lexicon else None)


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, in the tokenizer's own pieces. Tasks pass partial counts on, in pieces of bounded size."""

    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = _vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            texts = batch.column(0).fill_null("")
            for i, last in groups(texts):
                part = texts.slice(i, last - i)
                if vocabulary.cuttable:
                    words, index, _ = distinct_words(part)
                    for word, n in zip(words.to_pylist(), np.bincount(index, minlength=len(words)).tolist(), strict=True):
                        for p in vocabulary.word_pieces(word.decode("utf-8", "surrogatepass")):
                            counts[p] += n
                else:
                    for text in part.to_pylist():
                        counts.update(vocabulary.pieces(text))
                if len(counts) > COUNT_WORDS:
                    yield out()
        yield out()
        give_back()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(spark: SparkSession, docs: DataFrame, path: str, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the most frequent words, at most `words`, and has Spark ship the file; returns its name.

    A histogram of the counts tells from which count on they are few enough, so only they reach the driver.
    """
    keep = Written(spark, "bpe")
    counts = keep(word_counts(docs, path, text_col).filter("n > 1 AND substring(word, 1, 1) <> '\\u0000'").withColumn("step", F.floor(F.log2("n") * STEPS)), "counts")
    least, room = None, words
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    rows = counts.filter(F.col("step") >= least).select("word").collect() if least is not None else []
    keep.drop("counts")
    vocabulary = _vocabulary(path)
    made = compile_lexicon({r["word"]: vocabulary.merge(r["word"]) for r in rows})
    at = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), "")
    atexit.register(shutil.rmtree, at, ignore_errors=True)  # Spark serves the file to executors, later ones too, until then
    name = f"{os.path.basename(at[:-1])}.bin"
    with open(at + name, "wb") as f:
        f.write(made)
    spark.sparkContext.addFile(at + name)
    return name


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts together have about GROUP_BYTES, at least one row each."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size > GROUP_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, path: str, lexicon: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers), n_tokens and decoded added."""
    text_batches(docs.sparkSession)
    rows = docs.select(*(c for c in docs.columns if c not in ADDED))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "ids binary", "n_tokens long", "decoded string"])
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, lexicon)
        for batch in batches:
            texts = batch.column(at).fill_null("")
            for i, last in groups(texts):
                part = batch.slice(i, last - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *encoder.columns(texts.slice(i, last - i))], [*part.schema.names, *ADDED])
        encoder.forget()
        give_back()

    return rows.mapInArrow(run, schema)
