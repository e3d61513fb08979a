"""Whole results of learnt operators against plain Python that counts and adds one thing at a time."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tests.llm.test_models import PATH, toxic_corpus
from tetrafield.llm import bpe, html_text, language_id, toxicity

tokenizers = pytest.importorskip("tokenizers")


def plain_grams(text):
    chars = [ord(c) for c in (text or "").lower()]
    letters = [chr(c).isalpha() if c < 0x3000 else True for c in chars]
    points = [c if ok else 32 for c, ok in zip(chars, letters)]
    kept = [p for k, p in enumerate(points) if k == 0 or letters[k] or letters[k - 1]]
    row = [32, *kept, 32] if chars else []
    return [(((a << 42 | b << 21 | c) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - language_id.BITS) for a, b, c in zip(row, row[1:], row[2:])]


def softmax(values):
    raised = [math.exp(v - max(values)) for v in values]
    return [r / sum(raised) for r in raised]


class Plain:
    """The fusion, one page at a time."""

    def __init__(self, docs):
        rows = [(t, lang) for t, lang in docs if t is not None and lang is not None]
        self.names = sorted({lang for _, lang in rows})
        self.share = [sum(lang == n for _, lang in rows) / len(rows) for n in self.names]
        self.counts = {n: Counter(g for t, lang in rows if lang == n for g in plain_grams(t)) for n in self.names}
        self.whole = Counter(g for c in self.counts.values() for g in c.elements())
        self.size = 2**language_id.BITS
        self.sum = sum(self.whole.values()) + 0.1 * self.size

    def text(self, text):
        grams = plain_grams(text)
        logs = [sum(math.log((self.counts[n][g] + 200 * (self.whole[g] + 0.1) / self.sum) / (sum(self.counts[n].values()) + 200)) for g in grams) for n in self.names]
        return [(v - max(logs)) * language_id.TEXT_WEIGHT for v in logs]

    def identify(self, pages):
        n = range(len(self.names))
        read = []
        for url, html, text in pages:
            host = url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
            tag = html.split("lang=")[1][:2] if html and "lang=" in html else ""
            tag = tag if tag in self.names or not tag else "?"
            own = self.text(text)
            read.append((host, ".".join(host.split(".")[-2:]), host.split(".")[-1], tag, own, softmax([a + math.log(p) for a, p in zip(own, self.share)])))

        def votes(key):
            sums, rows = defaultdict(lambda: [0.0 for _ in n]), Counter()
            for r in read:
                sums[key(r)] = [a + b for a, b in zip(sums[key(r)], r[5])]
                rows[key(r)] += 1
            return sums, rows

        (world, every), (hosts, in_host), (domains, in_domain) = votes(lambda r: ""), votes(lambda r: r[0]), votes(lambda r: r[1])
        spread = [(v + 1) / (every[""] + len(n)) for v in world[""]]

        def channel(k):
            sums, rows = votes(lambda r: r[k])
            sums.pop("", None), rows.pop("", None)
            of = [sum(s[i] for s in sums.values()) for i in n]
            return {v: [math.log((s[i] + language_id.CHANNEL_PRIOR * rows[v] / sum(rows.values())) / (of[i] + language_id.CHANNEL_PRIOR)) for i in n] for v, s in sums.items()}

        tags, suffixes, out = channel(3), channel(2), []
        for host, domain, suffix, tag, own, vote in read:
            prior = [math.log(p) for p in spread]
            if host:
                wide = [(v + language_id.DOMAIN_PRIOR * p) / (in_domain[domain] + language_id.DOMAIN_PRIOR) for v, p in zip(domains[domain], spread)]
                prior = [math.log((max(h - v, 0) + language_id.HOST_PRIOR * w) / (in_host[host] - 1 + language_id.HOST_PRIOR)) for h, v, w in zip(hosts[host], vote, wide)]
            post = softmax([a + b + tags.get(tag, [0.0] * len(n))[i] + suffixes.get(suffix, [0.0] * len(n))[i] for i, (a, b) in enumerate(zip(own, prior))])
            out.append((self.names[post.index(max(post))], max(post)))
        return out


def test_language_fusion_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60)
    rows = [(r.text, r.lang) for r in docs.collect()]
    rng, texts = random.Random(2), [t for t, _ in rows if t]
    cut = lambda: " ".join(rng.choice(texts).split()[: rng.randrange(6)])
    pages = [(f"http://big.example.fr/{k}", f"<p>{(t := cut())}</p>", t) for k in range(300)]  # a host that holds most rows
    for k in range(60):
        t, tag = cut(), rng.choice(["", "de", "en", "xx"])
        pages.append((rng.choice([f"https://h{k % 7}.site{k % 3}.de/{k}", "http://localhost/x", "nothing", None]), f"<html lang={tag}><p>{t}</p>" if tag else f"<p>{t}</p>", t))
    pages += [(None, None, ""), ("http://big.example.fr/x", None, ""), (None, "", ""), ("http://lone.org", "<p> 12 ... 34 </p>", " 12 ... 34 ")] + pages[:3]
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    model = language_id.fit(spark.createDataFrame([*rows, (None, "fr"), ("text", None)], "text string, lang string").repartition(3))
    got = {r.page_id: r for r in language_id.identify(spark, df, model, html_col="html", url_col="url").collect()}
    # the markup's place is blank in the visible text, and runs of blanks count as one
    want = Plain(rows).identify([(u, h, language_id.visible(h) if h else "") for u, h, _ in pages])
    assert len(got) == len(pages)
    for k, (language, confidence) in enumerate(want):
        assert got[k].confidence == pytest.approx(confidence, rel=1e-4), pages[k]
        assert got[k].language == language or confidence == pytest.approx(0.5, abs=1e-3), pages[k]


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([("same words here", "zu"), ("same words here", "af"), ("same words here", "ml")], "text string, lang string")
    model = language_id.fit(docs)
    asked = spark.createDataFrame([(1, "same words"), (2, None), (3, ""), (4, "other")], "doc_id long, text string")
    got = language_id.identify(spark, asked, model, text_col="text").collect()
    assert {r.language for r in got} == {"af"} and all(r.confidence == pytest.approx(1 / 3) for r in got)


def plain_pieces(word):
    raw = b"^" + word.encode() + b"$"
    found = set()
    for k, n in enumerate(toxicity.GRAMS):
        for i in range(len(raw) - n + 1):
            found.add((int.from_bytes(raw[i : i + n], "big") * int(toxicity._MIX[k]) % 2**64) >> (64 - toxicity.BITS))
    whole = sum(b * int(toxicity._PLACES[i & 63]) for i, b in enumerate(raw)) % 2**64
    return found | {(whole * int(toxicity._MIX[-1]) % 2**64) >> (64 - toxicity.BITS)}


def test_toxicity_scores_equal_plain_python(spark):
    rows, df = toxic_corpus(spark, 120, seed=9)
    rows += [(900, "1d10t and m.o.r.o.n !! thing", 1), (901, "", 0), (902, "  \n ", 0), (903, None, 0), (904, "s c u m on the red thing", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(spark, df, df.select("doc_id", "toxic"))

    def words(text):
        text = text or ""
        tokens = set(text.split()) | {m.group(0) if " " in m.group(0) else m.group(0) + " " for m in toxicity.SPACED.finditer(text)}
        return {w for t in tokens for w in toxicity.restore(t, model.lm)}

    own = [words(t) for _, t, _ in rows]
    counts, total = (Counter(), Counter()), [0, 0]
    for ws, (_, _, y) in zip(own, rows):
        counts[y].update(set().union(*(plain_pieces(w) for w in ws)))
        total[y] += 1
    assert [int(model.clean[-1]), int(model.toxic[-1])] == total
    assert all(int(model.clean[p]) == counts[0][p] and int(model.toxic[p]) == counts[1][p] for p in range(2**toxicity.BITS))

    def features(ws, y=None):
        t, c = total[1] - (y == 1), total[0] - (y == 0)
        base = min(max(t / (t + c), 1e-3), 1 - 1e-3)

        def odds(p):
            a, b = counts[1][p] - (y == 1), counts[0][p] - (y == 0)
            rate = (a + toxicity.PRIOR_ROWS * base) / (a + b + toxicity.PRIOR_ROWS)
            return math.log(rate / (1 - rate)) - math.log(base / (1 - base))

        best = sorted((max(map(odds, plain_pieces(w))) for w in ws), reverse=True)[: toxicity.TOP]
        return [max(0.0, b) for b in best] + [0.0] * (toxicity.TOP - len(best))

    x, y = np.array([[*features(ws, r[2]), 1.0] for ws, r in zip(own, rows)]), np.array([r[2] for r in rows])
    w = model.weights
    # the penalised likelihood's gradient is nought where the regression stopped
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([1.0] * toxicity.TOP + [1e-6]) * w
    assert np.abs(gradient).max() < 1e-5
    for r in toxicity.score(spark, df, model).collect():
        at = [i for i, *_ in rows].index(r.doc_id)
        z = float(np.dot([*features(own[at]), 1.0], w))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and r.predicted == int(r.score >= 0.3)


def test_odd_texts_decode_as_the_library_does(spark):
    texts = [None, "", "hello<|endoftext|>World's it'll", "ΑΣ ΣΑΣ Å é", "x\x1cy\x85z　q", "½ ²", "日本語 😀👍🏽", "a" * 3000, "--'s don't", "n't ' s . ,"]
    docs = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    library = tokenizers.Tokenizer.from_file(PATH)
    got = bpe.encode(docs, PATH, bpe.build_lexicon(spark, docs, PATH, words=5)).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r.decoded == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_repeated_pages_stay_rows(spark):
    page = "<html><body><nav><a href=x>Menu one</a></nav><article><h1>Title</h1><p>First words, and some more of them here.</article></body></html>"
    pages = spark.createDataFrame([(1, page), (1, page), (2, page), (2, None), (2, None)], "page_id long, html string")
    got = html_text.main_text(spark, pages).groupBy("page_id", "text").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.page_id, bool(r.text), r.n) for r in got) == [(1, True, 2), (2, False, 2), (2, True, 1)]
