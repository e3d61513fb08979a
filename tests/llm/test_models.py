"""Operators that Python code carries: against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tetrafield.llm import ann, bpe, components, html_pages, html_text, language_id, near_dedup, queries, toxicity
from tetrafield.llm.common import Written

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_path()


def test_bpe_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = tokenizers.Tokenizer.from_file(PATH)
    for r in queries.op6_bpe(spark, SF).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts(spark):
    texts = [None, "", "hello<|endoftext|>World's it'll", "ΑΣ ΣΑΣ Å é", "x\x1cy\x85z\u3000q", "½ ²", "日本語 😀👍🏽", "a" * 30_000, "ab" * 500, "--'s don't"]
    docs = spark.createDataFrame([(n, t, "own") for n, t in enumerate(texts + texts)], "doc_id long, text string, ids string")
    library = tokenizers.Tokenizer.from_file(PATH)
    name = bpe.build_lexicon(spark, docs, PATH, words=5)
    for r in bpe.encode(docs, PATH, name).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0), PATH, name).count() == 0


def test_lexicon_is_exact_and_shared(tmp_path):
    entries = {w: [n, n + 1][: 1 + n % 2] for n, w in enumerate(["nation", "station", "ration", "rations", "a", "é", "na"])}
    (tmp_path / "lex").write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(tmp_path / "lex"))
    numbers = lexicon.numbers([*entries, "nat", "x", "stations", ""])
    assert [lexicon.ids_of(n).tolist() for n in numbers[: len(entries)]] == list(entries.values()) and (numbers[len(entries) :] < 0).all()
    assert len(lexicon.final) < sum(map(len, entries))
    assert bpe.compile_lexicon({}) and True


def test_merges_together_equal_merges_alone():
    v, rng = bpe.Vocabulary(PATH), random.Random(1)
    words = ["a" * n for n in range(1, 30)] + ["".join(rng.choice("abnth") for _ in range(rng.randrange(1, 18))) for _ in range(500)]
    assert [x.tolist() for x in v.merge_all(words)] == [v.merge(w) for w in words]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed=3):
    """Copies of a text with few to many changes, chains, exact copies, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(160)], []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    chain = list(base[::-1])
    for _ in range(12):
        chain[rng.randrange(len(chain))] = word()
        rows.append(" ".join(chain))
    rows += ["", None, "one two", "ONE  two", "one two three four five", " ".join(word() for _ in range(20_000))] + [" ".join(word() for _ in range(50)) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_each_distinct_word_is_taken_apart_once(monkeypatch):
    """Whatever the number of texts, a group's distinct words alone are taken apart; odd texts come out as the library has them."""
    rng = random.Random(3)
    bits = [*"aZ09.,;:!?'\"<|>-— \t\n\u00a0\u3000\x1c\u0130Σςñé\u0338\u0308=中", "<|endoftext|>", "don't", "it'S", "  ", "\r\n", "word", "<|EndOfText|>", "\u1112", "\u1161"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", " ", "\n"]
    encoder, library = bpe.Encoder(bpe.Vocabulary(PATH)), tokenizers.Tokenizer.from_file(PATH)
    for text, (ids, decoded) in zip(odd, encoder.encode_all(odd), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)
    calls, plain = [], bpe.Vocabulary.pieces
    monkeypatch.setattr(bpe.Vocabulary, "pieces", lambda self, text: calls.append(text) or plain(self, text))
    bpe.Encoder(encoder.vocabulary).encode_all(["Une pensée légère, une pensée."] * 300)
    assert sorted(calls) == [",", ".", "légère", "pensée"]


def test_near_duplicates_equal_brute_force(spark):
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(spark, docs).collect()}
    assert got == linked(rows)
    stay = near_dedup.deduplicate(spark, docs.withColumn("kept", F.lit("own")))
    assert {r.doc_id for r in stay.collect()} == {i for i, (_, c) in linked(rows).items() if i == c} and "kept" in stay.columns
    assert near_dedup.link(spark, docs.limit(0)).count() == 0


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_minhash_dedup(spark, SF).collect()}
    assert got == linked([tuple(r) for r in docs.collect()])


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (10, 12), (7, 7), (2, 1)] + [(100, n) for n in range(101, 200)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.component for r in components.components(edges, Written(spark, "t"), "c").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {n: 100 for n in range(100, 200)}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24)) * rng.uniform(0.5, 2, (700, 1))
    x[100:140] = x[100]
    rows = [(n, [float(c) for c in v]) for n, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1020, [None] * 24), (1040, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann.nearest(spark, df, F.col("vec_id") % 20 == 0, shard_rows=250).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        want = sorted(((-float(x[q] @ x[n]), n) for n in range(700) if n != q))[:20]
        assert sorted(found) == list(range(1, 21)) and all(s == pytest.approx(float(x[q] @ x[n])) for n, s in found.values())
        assert list(found) and [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda t: (-t[1], t[0]))
        hits += len({n for _, n in want} & {n for n, _ in found.values()})
    assert hits / (20 * len(got)) >= 0.95
    assert ann.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_ties_and_few(spark):
    same = spark.createDataFrame([(n, [1.0, 0.0]) for n in range(60)] + [(60, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(spark, same, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == list(range(20))
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(spark, few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]


def test_extraction_on_held_out_pages():
    model, rng, right = html_text.trained(), np.random.default_rng(12345), 0
    for _ in range(120):
        page = html_pages.page(rng)
        want = [n.own[1:] for n in html_text.parse(page) if n.own.startswith("①")]
        right += html_text.extract(model, [page.replace("①", "")])[0].split("\n\n") == want
    assert right >= 102


def test_extraction_cases(spark):
    article = "<html><body><nav><a href=x>Menu one</a><a href=y>Menu two</a></nav><article><h1>Title &amp; more</h1><p><b>First   words.<br><p>Second\nwords, and more of them.</p></article><footer>&copy; x</footer>"
    docs = spark.createDataFrame([(1, article, "own"), (2, None, "own"), (3, "", "own"), (4, "just text", "own"), (5, "<p", "own"), (6, article + "<p>" * 20_000, "own")], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(spark, docs).collect()}
    want = "Title & more\n\nFirst words.\n\nSecond words, and more of them."
    assert got[1] == (want, len(want))
    assert got[2] == got[3] == ("", 0) and got[4] == ("just text", 9) and 6 in got
    assert html_text.main_text(spark, docs.limit(0)).count() == 0


def test_extraction_of_the_table(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op3_html_text(spark, SF).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


BAD = ["idiot", "moron", "scum"]


def toxic_corpus(spark, n=400, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "in", "ed", "a"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out_and_disguised(spark):
    rows, df = toxic_corpus(spark)
    train = df.filter(~queries.held_out("doc_id"))
    model = toxicity.fit(spark, df.select("doc_id", "text"), train.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(spark, df, model).collect()}
    test = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == y for i, y in test) / len(test) >= 0.97 and all(0 <= r.score <= 1 for r in got.values())
    clean = next(t for i, t, y in rows if not y)
    for disguise in ("1d10t", "i d i o t", "m.o.r.o.n", "$cum", "moooooron", "m0r0n!!"):
        assert model.score(f"{clean} {disguise} {clean}") >= 0.3, disguise
    assert model.score(clean) < 0.3


def test_toxicity_cases(spark):
    _, df = toxic_corpus(spark, 60)
    labels = df.select("doc_id", "toxic")
    odd = spark.createDataFrame([(1, None, "own"), (2, "", "own"), (3, "a" * 200_000, "own"), (3, "a" * 200_000, "own"), (4, "1" * 50, "own")], "doc_id long, text string, score string")
    model = toxicity.fit(spark, df, labels)
    got = toxicity.score(spark, odd, model).collect()
    assert len(got) == 5 and got[0].score == got[1].score and got[2].score == got[3].score
    assert toxicity.score(spark, odd.limit(0), model).count() == 0
    unlabelled = toxicity.fit(spark, df, labels.limit(0))
    assert {r.score for r in toxicity.score(spark, odd, unlabelled).collect()} == {0.0}


def test_language_fusion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    got = language_id.identify(spark, docs, model, text_col="text")
    right = got.join(docs.select("doc_id", "lang"), ["doc_id", "lang"]).agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.98
    french = docs.filter("lang = 'fr'").first().text
    pages = [(n, f"http://a.fr/{n}", f"<html lang=fr><p>{french}</p>") for n in range(8)] + [(8, "http://a.fr/x", ""), (9, None, None), (10, "http://b.org", "<html lang='fr-FR'></html>"), (11, "http://b.org", f"<p>{french * 20}</p>")]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, language string")
    got = {r.page_id: r.language for r in language_id.identify(spark, df, model, html_col="html", url_col="url").collect()}
    assert len(got) == 12 and all(got[n] == "fr" for n in (*range(9), 10, 11)) and got[9] in model[0]
    assert language_id.identify(spark, df.limit(0), model, html_col="html", url_col="url").count() == 0
    empty = language_id.fit(docs.limit(0))
    assert language_id.identify(spark, docs, empty, text_col="text").filter("language IS NOT NULL").count() == 0


def test_every_label_is_a_language(spark):
    """More labels than a block holds, the rarest of them too, by text and by tag."""
    rng = random.Random(8)
    own = {f"l{chr(97 + n // 26)}{chr(97 + n % 26)}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in range(2 * language_id.BLOCK + 3)}
    text = lambda lang: " ".join(rng.choice(own[lang]) for _ in range(40))
    rows = [(f"{lang}{k}", text(lang), lang) for n, lang in enumerate(own) for k in range(1 + (n < 70))]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(3)
    model = language_id.fit(docs)
    assert model[0] == sorted(own) and model[1].shape[0] == len(model[2]) == len(own)
    got = language_id.identify(spark, docs, model, text_col="text").collect()
    assert len(got) == len(rows) and all(r.doc_id.startswith(r.language) for r in got)
    rare = list(own)[-20:]
    pages = [(lang, f"http://{lang}.example/{k}", f"<html lang={lang}><p>{text(lang) if k else ''}</p>") for lang in rare for k in range(3)]
    df = spark.createDataFrame(pages, "want string, url string, html string")
    got = language_id.identify(spark, df, model, html_col="html", url_col="url").collect()
    assert len(got) == len(pages) and all(r.language == r.want for r in got)


@pytest.mark.parametrize("size", [200, 400])
def test_a_family_below_the_threshold_stays_linear(spark, size):
    """Members of one family, hardly any pair linked: candidate rows and links grow with its size, not its square."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(240)], []
    for i in range(size):
        copy = list(base)
        for place in rng.sample(range(240), 4):
            copy[place] = word()
        rows.append((i, " ".join(copy)))
    written = {}

    class Counting(Written):
        def __call__(self, df, name):
            made = super().__call__(df, name)
            written[name] = made.count()
            return made

    near_dedup.Written = Counting
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        near_dedup.Written = Written
    assert got == linked(rows)
    assert written["likely"] <= written["members"] <= 34 * size
    assert all(n < size for name, n in written.items() if name.startswith("links"))


def test_buckets_are_joined_with_their_members_once_a_round(spark, monkeypatch):
    """A family below the threshold, settled in one round: joins on a bucket's key make three rows at most for each membership."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(240)], []
    for i in range(60):
        copy = list(base)
        for place in rng.sample(range(240), 4):
            copy[place] = word()
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, made = type(docs).join, []

    def counting(left, other, on=None, how=None):
        out = plain(left, other, on, how)
        if isinstance(on, str) and on == "key":
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "join", counting)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(spark, docs).collect()}
    assert got == linked(rows)
    assert made[0] > 500 and sum(made) <= 3 * made[0], made


def test_rows_that_share_an_id(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    one, two = [word() for _ in range(200)], [word() for _ in range(200)]
    near = [*two[:100], word(), *two[101:]]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, " ".join(near)), (None, " ".join(one)), (None, "alone"), (None, "alone"), (7, " ".join(one)), (7, " ".join(one)), (8, None), (8, None)]
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, n_shingles int, component_id string")
    got = sorted(near_dedup.link(spark, docs).collect(), key=str)
    assert len(got) == len(rows) and sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("5", "3"), ("5", "5"), ("7", "5"), ("7", "5"), ("8", "8"), ("8", "8"), ("None", "5"), ("None", "None"), ("None", "None")]
    stay = near_dedup.deduplicate(spark, docs)
    assert sorted((str(r.doc_id), str(r.text)) for r in stay.collect()) == sorted((a, str(b)) for a, b in [("5", " ".join(one)), ("3", " ".join(near)), ("None", "alone"), ("None", "alone"), ("8", None), ("8", None)])


def test_block_links_span_the_components(spark):
    """What a block gives back joins the same components as all its pairs would, with one link fewer than they have members."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 62, 120, np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(len(base), k, False)), rng.integers(0, 1 << 62, k, np.uint64)])) for k in rng.integers(0, 14, 150)]
    signature = near_dedup.signatures(sets, 238).astype(np.uint8)
    rows = {"node": np.arange(150), "comp": np.arange(150), "turn": np.full(150, 2), "signature": signature}
    links = near_dedup.block_links(rows, rows, sets, sets, 85)
    pairs = [(i, j) for i in range(150) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - n)]

    def roots(edges):
        own = list(range(150))
        for _ in range(150):
            for a, b in edges:
                own[a] = own[b] = min(own[a], own[b])
        return own

    assert roots(links) == roots(pairs) and len(links) == 150 - len(set(roots(pairs)))


def timed(seconds, f, *args):
    import time

    began = time.time()
    out = f(*args)
    assert time.time() - began < seconds
    return out


def test_no_page_holds_the_parser_up():
    for page in ("<a" * 200_000, "<a " + "<a \"" * 60_000, "<a '<b \">" * 40_000, "</script" * 50_000, "<script></script" * 30_000, "<div>" * 30_000, "<div><span>" * 20_000 + "</p>" * 20_000, "<li><p>" * 20_000, "<!--" * 50_000, "<!" * 100_000):
        assert timed(6, html_text.parse, page)
    nodes = html_text.parse("<div title='a > b'>one</div><p class=\"x>two</p><p>three")
    assert [n.own for n in nodes if n.own] == ["one", "two", "three"]


def test_no_token_holds_the_decoder_up(spark):
    _, df = toxic_corpus(spark, 60)
    model = toxicity.fit(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    for text in ("@" * 60 + "x", "@" * 100_000 + "x", "x" + "@" * 100_000, "$!" * 20_000, "a." * 10_000 + "ab", "a " * 10_000 + "ab", "x!*" * 5_000):
        assert 0 <= timed(6, model.score, text) <= 1


def test_trimming_of_words():
    for word, want in (("..idiot!!", "idiot"), ("a@", "a@"), ("a@@", "a"), ("a$$", "a$$"), ("a$$$", "a"), ("(x", "(x"), ("@x+", "@x"), ("...", ""), ("@@", ""), ("x@@$$$..", "x")):
        assert toxicity.bare(word) == want


def test_decoding_equals_all_readings():
    """Viterbi's reading costs no more than any other reading of the lattice."""
    import itertools

    rng = np.random.default_rng(3)
    model = toxicity.language_model(rng.integers(0, 50, toxicity.N**3).astype(float))

    def cost(readings):
        total, x, y = sum(p for _, p in readings), 0, 0
        for c in "".join(r for r, _ in readings) + " ":
            z = toxicity.code(c)
            if z or y:
                total += float(model[x, y, z])
            x, y = y, z
        return total

    for word in ("1d10t", "$c*m", "m.o.r", "aaab", "b@d!", "x", "l33t"):
        columns = toxicity.lattice(word)
        got = toxicity.viterbi(columns, model)
        best = min(cost(r) for r in itertools.product(*columns))
        assert min(cost(r) for r in itertools.product(*columns) if "".join(x for x, _ in r) == got.rstrip(" ") or "".join(x for x, _ in r) + " " == got) == pytest.approx(best)


def test_one_word_counts_once(spark):
    """However often and in whatever spelling a word stands in a text."""
    _, df = toxic_corpus(spark, 200)
    model = toxicity.fit(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model.score("idiot") == model.score("Idiot, idiot IDIOT. idiot!") and model.score("idiot moron") > model.score("idiot idiot,")


def test_nearest_of_huge_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 6)) * 10.0 ** rng.choice([100, 101, 102], (60, 1))
    rows = [(n, [float(c) for c in v]) for n, v in enumerate(x)] * 2 + [(None, [1.0] * 6)]
    got = ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(got) == 15
    for q in (0, 20, 40):
        want = sorted((-float((x[n] * x[q]).sum()), n) for n in range(60) if n != q)[:5]
        assert {r.vec_id for r in got if r.query_id == q} == {n for _, n in want}


def test_language_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "aaa bbb ccc", "x"), (2, "ddd eee fff", "y"), (3, "aaa bbb ccc", "x"), (4, "ddd eee fff", "y")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    asked = spark.createDataFrame([(1, "aaa bbb"), (1, "aaa bbb"), (2, "zzz"), (2, "zzz"), (3, "eee fff")], "doc_id long, text string")
    got = {}
    for r in language_id.identify(spark, asked, model, text_col="text").collect():
        got.setdefault(r.doc_id, []).append((r.language, r.confidence))
    assert all(len(set(v)) == 1 for v in got.values()) and [len(got[k]) for k in (1, 2, 3)] == [2, 2, 1]
    assert got[1][0][0] == "x" and got[3][0][0] == "y"
