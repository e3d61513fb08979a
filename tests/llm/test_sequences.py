"""Conversation repair, token counts and phrases against plain versions, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tetrafield.llm import conversations, phrases, queries, token_counts

AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in convs.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    return convs


def plain_repair(rows):
    """A table of the best rest of every (row, state), filled from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        inner = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    rest = [(0, "", ()) if s in (0, 3) else None for s in range(4)]
    for i in range(len(rows), -1, -1):
        ways = [[] for _ in range(4)]
        for s in range(4):
            if i == len(rows):
                ways[s] += [rest[s]] * (rest[s] is not None)
                continue
            (_, role, text), cut = rows[i], 3 * (faults[i] == "truncated")
            if rest[s]:
                ways[s].append((rest[s][0] + 4, "D" + rest[s][1], rest[s][2]))
            if faults[i] in ("blank", "duplicate"):
                continue
            for cost, edit, made in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                to = s if not made else AFTER.get((s, made[0]))
                if to is not None and rest[to]:
                    ways[s].append((cost + cut + rest[to][0], edit + rest[to][1], ((made, text), *rest[to][2])))
        rest = [min(w) if w else None for w in ways]
        for _ in range(6):  # inserts, until nothing changes
            for (s, first), to in AFTER.items():
                if first in "ua" and rest[to]:
                    made = (3 + rest[to][0], "I" + rest[to][1], (("user" if first == "u" else "assistant", ""), *rest[to][2]))
                    rest[s] = made if rest[s] is None else min(rest[s], made)
    cost, audit, out = rest[0]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == {k: plain_repair(v) for k, v in damaged(rows).items()}


@pytest.mark.parametrize("segment", [256, 4])
def test_conversation_odd_rows(spark, segment):
    rnd, rows = random.Random(3), []
    texts = ["Hi.", "Ok", "Yes! ", "", None, " \n", "a. b", "What?\t", "x" * 20_000, *(f"Hm.{n}." for n in range(40)), *(f"z{n}" for n in range(9))]
    for conv in range(150):
        for _ in range(600 if conv == 5 else rnd.choice([1, 2, 3, 6, 12, 40])):
            rows.append((conv or None, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rnd.choice(texts)))
    rows += [(500, None, None, None)] * 3 + [(501, 7, "user", "Same.")] * 700 + [(502, n, "user", "Same.") for n in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash")).repartition(3)
    out = conversations.repair(spark, conversations.damage(docs), segment).withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256))
    assert {r.conv_id: tuple(r[c] for c in NAMES) for r in out.collect()} == {k: plain_repair(v) for k, v in damaged(rows).items()}
    assert conversations.repair(spark, conversations.damage(docs.limit(0))).count() == 0


def test_search_from_both_ends_equals_the_table():
    rnd = random.Random(1)
    for _ in range(300):
        rows = [(None, rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b.", "c", "", "d!"])) for _ in range(rnd.randrange(0, 12))]
        own = conversations.Segment()
        for turn, role, text in rows:
            own.add(turn, role, text, (role, text) in own.turns)
        assert conversations.cheapest(own.rows) == plain_repair(rows)[5:7]


def test_token_count_query_equals_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_token_counts(spark, SF).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_token_count_odd_texts(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, rnd = public.path("byte_bpe_50k.json"), random.Random(5)
    library = tokenizers.Tokenizer.from_file(path)
    letters = [" ", " ", "\n", "\t", "a", "b", "Z", "1", "9", "'", "s", "t", ".", "-", "é", "ß", "²", "\xa0", "　", "\x1c", "日", "😀", "́", "<|endoftext|>", "l", "'ll", "\x85"]
    texts = [None, "", "  a  b   c ", "\n\n x\n y \n", "a<|endoftext|>b <|endoftext|> c<|endoftext|>", "a" * 5000, "".join(rnd.choice("abcdefghij") for _ in range(20_000)), "don't I'll 's 're we've  's", "same", "same"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 50))) for _ in range(500)]
    docs = spark.createDataFrame([(n % 400, t, "own", n) for n, t in enumerate(texts)], "doc_id long, text string, n_tokens string, at int")
    got = token_counts.count_tokens(spark, docs, path, frequent=50)
    assert got.columns == ["doc_id", "at", "n_bytes", "n_tokens", "over_limit"]
    assert {r.at: r.n_tokens for r in got.collect()} == {n: len(library.encode(t or "", add_special_tokens=False).ids) for n, t in enumerate(texts)}
    assert token_counts.count_tokens(spark, docs.limit(0), path).count() == 0


def plain_phrases(docs, least, top):
    found, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        own = found.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            own.update(tuple(words[i : i + k]) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    out = set()
    for lang, f in found.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in known.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        rows = []
        for p, a in known.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score)))
        out |= {(lang, n, *r[-1]) for n, r in enumerate(sorted(rows)[:top], 1)}
    return out


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert {tuple(r[c] for c in PHRASE) for r in queries.op13_phrases(spark, SF).collect()} == plain_phrases(docs, 100, 2000)


@pytest.mark.parametrize("least,top", [(3, 200), (2, 100_000)])
def test_phrases_odd_texts(spark, least, top):
    rnd = random.Random(2)
    words = ["a", "A", "b", "É", "é", "İ", "x\xa0y", "日本", "\x1c", "-", "w" * 3000, *(f"r{n}" for n in range(30))]
    join = [" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "!"]
    docs = [("".join(rnd.choice(words) + rnd.choice(join) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", None, "und", "de"])) for _ in range(200)]
    docs += [(None, "en"), ("", None), ("a a a a a a a", "en")] + [("the very same line of words", "fr")] * 9
    frame = spark.createDataFrame([(*d, "own") for d in docs], "text string, lang string, score string").repartition(5)
    assert {tuple(r[c] for c in PHRASE) for r in phrases.collocations(spark, frame, least, top).collect()} == plain_phrases(docs, least, top)
    assert phrases.collocations(spark, frame.limit(0)).count() == 0


def test_transducers_keep_their_rows():
    rnd = np.random.default_rng(4)
    rows, weights = phrases.summed(rnd.integers(0, 6, (3000, 5)), np.ones(3000, np.int64), 6)
    made = phrases.Transducer.build(rows, weights)
    assert (made.rows() == rows).all() and weights.sum() == 3000
    asked = rnd.integers(0, 7, (500, 5))
    known = dict(zip(map(tuple, rows.tolist()), weights.tolist()))
    assert made.weigh(asked).tolist() == [known.get(tuple(a), 0) for a in asked.tolist()]
    symbols = sum(len(s) for _, s, _ in made.levels)
    assert symbols < sum(len(p) for p in phrases.prefixes(rows)[1:])  # states are shared


def test_chunks_are_words_and_marks():
    """Marks and line feeds don't make new chunks of words, and the pre-tokens stay those of the whole text."""
    distinct, index, begins = token_counts.chunks(pa.array(["one two, one\ntwo. one", "", "two,one"]))
    words = [w.decode() for w in distinct.to_pylist()]
    assert [[words[i] for i in index[a:b]] for a, b in zip(begins, begins[1:])] == [["one", " two", ",", " one", "\n", "two", ".", " one"], [], ["two", ",", "one"]]
    rng = random.Random(4)
    bits = [*"aZ09.,;:!?'\"<|>-— \t\n\u00a0\u3000\x1c\x85ñé\u0338\u0308中", "  ", "\r\n", "\n\n", "'s", "word", "don't"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    distinct, index, begins = token_counts.chunks(pa.array(odd))
    pieces = token_counts.Pieces([])
    own = [pieces(w.decode())[0] for w in distinct.to_pylist()]
    for text, a, b in zip(odd, begins, begins[1:]):
        assert [p for i in index[a:b] for p in own[i]] == pieces.pattern.findall(text)
