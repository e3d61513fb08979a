"""Exact dedup, URL rules, mixing and pseudonyms: against SQL, brute force and planted cases."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.llm import exact_dedup, mixing, pii, queries, url_filter

ODD = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "x" * 100_000), (6, "x" * 100_000), (6, "x" * 100_000), (7, " a b"), (None, "a b"), (8, "unique")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name])


def test_exact_dedup_cases(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in ODD], "doc_id long, text string, kept string")
    rows = exact_dedup.mark(exact_dedup.with_digest(docs), slots_log2=10).collect()
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got == [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 3, True), (6, 5, 3, False), (6, 5, 3, False), (7, 7, 1, True), (8, 8, 1, True), (99, 1, 3, False)]
    assert next(r for r in rows if r.doc_id == 2).text_sha256 == hashlib.sha256(b"a b").hexdigest()
    stay = exact_dedup.deduplicate(spark, docs, slots_log2=10)
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3, 5, 7, 8] and stay.columns == docs.columns and stay.first().kept == "own"
    twice = spark.createDataFrame([(1, "t"), (1, "t"), (1, "t")], "doc_id long, text string")
    assert exact_dedup.deduplicate(spark, twice).count() == 1
    assert exact_dedup.deduplicate(spark, docs.limit(0)).count() == 0


def test_exact_dedup_full_filter(spark):
    """With a filter far too small all rows shuffle, and the result is the same."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 4000).alias("text"))
    small, large = (exact_dedup.mark(exact_dedup.with_digest(docs), slots_log2=n).filter("kept").count() for n in (10, 20))
    assert small == large == 4000


URLS = [None, "", "no scheme", "HTTP://A.Example.COM/en/x", "http://example.com", "http://example.com/", "http://www.example.com/en/1?q#f", "https://x.net/es/", "https://net/fr/1", "http://notnet/fr/", "x://y://z", "http://u@h.com:80/p", "http://" + "a." * 3000 + "com/" + "p" * 50_000]


def test_url_cases(spark):
    def judged(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")

    pages = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    got = url_filter.judge(pages, url_filter.rules_table(spark)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(pages, none).collect()} == {"allow"}
    unaligned = spark.createDataFrame([("example.com", "/en/1", "block"), ("example.com", "/en/1", "allow")], "host string, path string, verdict string")
    assert url_filter.judge(pages, unaligned).filter("verdict = 'block'").count() == 2
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_mixing_budgets(spark):
    """A short leaf's rest goes to its siblings before it leaves the branch."""
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "z", "4", 1000)], "d string, l string, s string, total long")
    got = {r.s: r.budget for r in mixing.budgets(spark, leaves, ["d", "l", "s"], {}, 1200 / 3100, 1).collect()}
    assert got == {"1": 100, "2": 200, "3": 300, "4": 600}
    got = {r.s: r.budget for r in mixing.budgets(spark, leaves, ["d", "l", "s"], {"a": 0.0}, 1200 / 3100, 1).collect()}
    assert got["1"] == got["2"] == got["3"] == 0 and got["4"] == 1000
    got = {r.s: r.budget for r in mixing.budgets(spark, leaves, ["d", "l", "s"], {}, 10.0, 2).collect()}
    assert got == {"1": 200, "2": 2000, "3": 2000, "4": 2000}


def test_mixing_rows(spark):
    rows = [(n, " ".join(["w"] * (n % 7)), "en" if n % 3 else None, f"s{n % 2}") for n in range(300)] + [(300, None, "en", None), (301, "w " * 5000, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(spark, docs, mixing.document_levels(), weights={}, share=0.5, epochs=2)
    taken = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    total = mixed.agg(F.sum("n_tokens")).first()[0]
    assert mixed.count() == len(rows) and 0.2 * total < taken <= 0.5 * total
    again = mixing.mix(spark, docs.repartition(7), mixing.document_levels(), weights={}, share=0.5, epochs=2)
    assert {(r.doc_id, r.copies) for r in mixed.collect()} == {(r.doc_id, r.copies) for r in again.collect()}
    assert mixing.take(spark, docs, mixing.document_levels(), share=5.0).count() == 2 * len(rows) - 1
    assert mixing.take(spark, docs, mixing.document_levels(), share=0.0).filter("text <> ''").count() == 0
    assert mixing.take(spark, docs.limit(0), mixing.document_levels()).count() == 0


def pseudonyms(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.p for r in df.select(pii.pseudonym(F.col("v"), "k").alias("p")).collect()]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    cards = ["4041894974608795", "4041-8949-7460-8795", "4041 8949 7460 8795"]
    got = pseudonyms(spark, *cards)
    assert len({re.sub(r"\D", "", g) for g in got}) == 1 and luhn(re.sub(r"\D", "", got[0])) and got[0] != cards[0]
    assert [re.sub(r"\d", "9", g) for g in got] == [re.sub(r"\d", "9", c) for c in cards]
    invalid = ["4041894974608796", "0000000000000000", "300.1.2.3", "2023-02-30", "000-12-3456", "DE88370400440532013000"]
    assert pseudonyms(spark, *invalid) == invalid
    iso, dotted, slashed = pseudonyms(spark, "1985-02-28", "28.02.1985", "28/02/1985")
    assert datetime.date.fromisoformat(iso).strftime("%d.%m.%Y") == dotted == slashed.replace("/", ".") and 1950 <= int(iso[:4]) < 2050
    iban = pseudonyms(spark, "DE89370400440532013000")[0]
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com", pseudonyms(spark, "bosbt.42@mail8.example.com")[0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", pseudonyms(spark, "+1 (988) 555-2485")[0])


def test_pseudonyms_are_one_to_one(spark):
    days = spark.range(36_524).select(F.date_add(F.lit("1850-01-01"), F.col("id").cast("int")).cast("string").alias("v"))
    assert days.select(pii.pseudonym(F.col("v"), "k").alias("p")).distinct().count() == 36_524
    three = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    made = three.select(pii.permute_signs(F.col("v"), "k", F.lit("t")).alias("p"))
    assert made.distinct().count() == 2000 and made.filter("p rlike '^[0-9]{4}$'").count() == 2000


def test_pseudonymised_texts(spark):
    rows = [(1, "mail bosbt.42@mail8.example.com ip 42.144.35.254 call +1 (988) 555-2485 pay 4041894974608795."), (2, None), (3, ""), (4, "nothing 12 here"), (5, "w " * 50_000 + "42.144.35.254")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_replaced int")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert got[1].n_replaced == 4 and got[1].text.startswith("mail ") and got[1].text.endswith(".") and not any(x in got[1].text for x in ("bosbt", "42.144.35.254", "988", "4041894974608795"))
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing 12 here" and got[5].n_replaced == 1
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", got[1].text)[0]
    assert got[5].text.endswith(ip)
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


CARD, IBANS = "4111 1111 1111 1111", ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "AT611904300234573201"]
FOLLOWED = [
    *((CARD, rest) for rest in (" 12/26", " 123", " 1", "-123", " 2026", "-2026", ".", " 12/26 x")),
    *((iban, rest) for iban in IBANS for rest in (" BIC", " 100 EUR", " BANK SWIFT XYZ", " 2026 REF7", ".", "")),
]


def test_numbers_followed_by_others(spark):
    """What follows a valid number, or stands before it, stays; the number itself never does."""
    rows = [f"{before}{v}{rest}" for v, rest in FOLLOWED for before in ("pay ", "year 2024 ")] + ["AB12 4111 1111 1111 1111"]
    alone = {r.text: r.p for r in spark.createDataFrame([(v,) for v in (CARD, *IBANS)], "text string").select("text", pii.pseudonym(F.col("text"), "k").alias("p")).collect()}
    assert all(v != p for v, p in alone.items())
    want = [f"{before}{alone[v]}{rest}" for v, rest in FOLLOWED for before in ("pay ", "year 2024 ")] + [f"AB12 {alone[CARD]}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymise(docs, "k").collect()}
    assert [got[i] for i in range(len(rows))] == [(t, 1) for t in want]


def test_numbers_one_after_the_other(spark):
    """A number that a wider window of the one before it would have swallowed is found too."""
    parts = [IBANS[1], CARD, "123-45-6789", CARD, "12/26/2026", IBANS[0], "42.144.35.254"]
    docs = spark.createDataFrame([(0, " ".join(parts)), (1, " ".join(reversed(parts)))], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert got[0].n_replaced == got[1].n_replaced == len(parts) and not any(p in r.text for p in parts for r in got.values())


def feistel(value, key, tweak):
    """The permutation of a string of signs, written out plainly."""
    kinds = {c: a for a in (pii.DIGITS, pii.LOWERS, pii.UPPERS) for c in a}
    shape = "".join({pii.DIGITS: "0", pii.LOWERS: "a", pii.UPPERS: "A"}[kinds[c]] for c in value)
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        digest = hashlib.sha256("|".join([key, tweak, shape, str(r), b]).encode()).hexdigest()
        digest += "".join(hashlib.sha256(f"{digest}{i}".encode()).hexdigest() for i in range(1, len(a) // 16 + 1))
        a, b = b, "".join(kinds[c][(kinds[c].index(c) + int(digest[4 * i : 4 * i + 4], 16)) % len(kinds[c])] for i, c in enumerate(a))
    return a + b


def test_permutations_equal_a_plain_feistel_network(spark):
    values = ["7", "42", "abc", "Zz9", "4041894974608795", "0123456789abcdefghijABCDEFGHIJ0123456789"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.p for r in df.select(pii.permute_signs(F.col("v"), "key", F.lit("tweak")).alias("p")).collect()] == [feistel(v, "key", "tweak") for v in values]
    assert pseudonyms(spark, "bosbt.42@mail8.example.com", "4041894974608795")[0].replace(".", "", 1).split("@")[0] == feistel("bosbt42", "k", "emailmail8.example.com")
    assert pseudonyms(spark, "4041894974608795")[0][:-1] == feistel("404189497460879", "k", "card")


def test_long_addresses(spark):
    long = "x" * 70 + "@" + "a.b." * 20 + "example.com"
    rows = ["a@" + "b.c." * 2000, "a@" + "bb." * 3000, "a@" * 4000, "a" * 50_000 + "@", long, "joe@" + "b-" * 5000 + ".com", "write joe@a.example.com, now"]
    docs = spark.createDataFrame([(n, t, "own") for n, t in enumerate(rows + rows)], "doc_id long, text string, n_replaced string")
    got = {}
    for r in pii.pseudonymise(docs, "k").collect():
        got[r.doc_id] = (r.text, r.n_replaced)
    assert len(got) == 14 and all(got[n] == got[n + 7] for n in range(7))
    assert got[0][1] == got[2][1] == got[3][1] == got[5][1] == 0 and got[4][1] == got[6][1] == 1 and "joe@" not in got[6][0]


def test_mixing_keeps_clashing_columns(spark):
    rows = [(n, "a b c", "en", "s1", n * 10, "mine", "own") for n in range(20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, copies string, domain string")
    got = mixing.take(spark, docs, mixing.document_levels(), share=1.0, epochs=1)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows)
    mixed = mixing.mix(spark, docs, mixing.document_levels(), share=1.0, epochs=1)
    assert {(r.n_tokens, r.copies, r.domain) for r in mixed.collect()} == {(3, 1, "s")}


def test_filter_grows_with_the_rows():
    sizes = [exact_dedup.filter_size(n) for n in (0, 1, 128, 129, 1 << 20, 1 << 27, 1 << 40)]
    assert sizes == [10, 10, 10, 11, 23, 30, 30]


def test_hosts_of_many_labels(spark):
    rules = spark.createDataFrame([("c.example.com", "/", "block"), ("com", "/ok", "allow"), ("", "/x", "block")], "host string, path string, verdict string")
    urls = ["http://" + "a." * 30_000 + "c.example.com/ok", "http://" + "a." * 30_000 + "example.com/ok", "http://xc.example.com/", "http://c.example.com/"]
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == [("c.example.com/", "block"), ("com/ok", "allow"), (None, "allow"), ("c.example.com/", "block")]
