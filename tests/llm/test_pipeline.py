"""The pipeline against the stages' brute-force counterparts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.compare import SF
from tests.llm.test_models import family, shingles
from tetrafield.llm import mixing, queries, toxicity
from tetrafield.llm.common import Written

tokenizers = pytest.importorskip("tokenizers")


def plain_mix(rows, levels):
    """Copies of each row by water-filling written out plainly. rows: (id, text, lang, source)."""
    tokens = [len(re.findall(r"[^ \t-\r]+", t or "")) for _, t, _, _ in rows]
    paths = [tuple("/".join(p[: d + 1]) for d in range(3)) for p in levels]
    total, below = {}, {}
    for n, path in zip(tokens, paths, strict=True):
        for d, node in enumerate(path):
            total[node] = total.get(node, 0) + n
            below.setdefault(path[d - 1] if d else "", set()).add(node)
    budget = {"": min(math.floor(sum(tokens) * mixing.SHARE), mixing.EPOCHS * sum(tokens))}
    for parent in ["", *sorted(below.keys() - {""}, key=lambda p: p.count("/"))]:
        left, open_ = budget[parent], {n: mixing.WEIGHTS.get(n, 1.0) for n in below[parent]}
        while open_:
            part = left / sum(open_.values())
            full = [n for n, w in open_.items() if mixing.EPOCHS * total[n] <= part * w]
            for n in full:
                budget[n] = mixing.EPOCHS * total[n]
                left -= budget[n]
                del open_[n]
            if not full:
                budget |= {n: part * w for n, w in open_.items()}
                break
    copies = [0] * len(rows)
    for leaf in {p[-1] for p in paths}:
        own = [i for i, p in enumerate(paths) if p[-1] == leaf]
        whole, of = math.floor(round(budget[leaf], 3)), total[leaf]
        epochs = min(whole // of, mixing.EPOCHS) if of else 0
        spent = 0
        for i in sorted(own, key=lambda i: (hashlib.md5(f"{mixing.SEED}|{epochs}|{rows[i][0]}".encode()).hexdigest(), rows[i][0])):
            spent += tokens[i]
            copies[i] = epochs + (epochs < mixing.EPOCHS and spent <= whole - epochs * of)
    return copies


def brute(rows):
    """(id, text) that each stage after toxicity leaves, and the ids of the last."""
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r[1] or ""), r)
    exact = list(first.values())
    of = linked_at([r[:2] for r in exact], corpus_pipeline.NEAR_PERCENT)
    near = [r for r in exact if of[r[0]] == r[0]]
    copies = plain_mix(near, [(re.match(r"[^0-9]*", s or "")[0], lang or "", s or "") for _, _, lang, s in near])
    mixed = [r for r, n in zip(near, copies, strict=True) for _ in range(n)]
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    return exact, near, mixed, sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in mixed)


def run_stages(spark, docs, sf):
    """Each stage's rows, by the stages' own order."""
    kept, rows = [], docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = Written(spark, "test")(stage(spark, rows, sf), f"s{n}")
        kept.append(rows)
    return kept


def held_against_brute(spark, docs, sf):
    kept = run_stages(spark, docs, sf)
    assert all(sorted(k.columns) == sorted(docs.columns) for k in kept[:-1])
    clean = [(r.doc_id, r.text, r.lang, r.source) for r in kept[0].collect()]
    exact, near, mixed, ids = brute(clean)
    for rows, want in zip(kept[1:4], (exact, near, mixed), strict=True):
        assert sorted(r.doc_id for r in rows.collect()) == sorted(r[0] for r in want)
    assert sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in kept[4].collect()) == ids
    return kept, clean


def test_pipeline_rows(spark):
    """run() against the stages written out plainly; toxicity's decisions against its scorer, text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, clean = held_against_brute(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").filter(~queries.held_out("doc_id"))
    model = toxicity.fit(spark, docs, labels)
    assert {i for i, *_ in clean} == {r.doc_id for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD}
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, bytes(r.ids)) for r in got.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in kept[4].collect())


def test_pipeline_of_odd_rows(spark):
    """Null and empty texts, white space, a very long text, clashing extra columns, and an empty table."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [None, "", " \t", "one", "ONE", *(" ".join(word() for _ in range(60)) for _ in range(20)), " ".join(word() for _ in range(20_000))]
    rows = [(n, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"src{n % 3}", len(t or ""), "own", "own", "own", "own") for n, t in enumerate(texts + texts[:9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, copies string, domain string")
    kept, _ = held_against_brute(spark, docs, SF)
    assert {(r.kept, r.score, r.copies, r.domain) for r in kept[3].collect()} == {("own",) * 4}
    assert [k.count() for k in run_stages(spark, docs.limit(0), SF)] == [0] * 5


def linked_at(rows, percent):
    """The smallest id of each row's component, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    of = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and of[i] != of[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((of[i], of[j]))
                of = {k: low if c == high else c for k, c in of.items()}
    return of


def test_pipeline_links_near_copies_from_eighty_percent(spark):
    """Pairs between 80 and 85 per cent, alone and as the only joints of a chain."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [t for _, t in family()]
    for _ in range(20):
        words = [word() for _ in range(104)]  # 100 shingles, of which two distant changes take ten: 90 of 110
        for place in (20, 60):
            rows.append(" ".join(words))
            words = [*words[:place], word(), *words[place + 1 : place + 20], word(), *words[place + 21 :]]
        rows.append(" ".join(words))
    rows = list(enumerate(rows))
    want, strict = linked_at(rows, 80), linked_at(rows, 85)
    assert len({*want.values()}) + 40 <= len({*strict.values()})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {i for i, c in want.items() if i == c}
