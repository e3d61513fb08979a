"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Candidates are found by regular expressions, then validated: card numbers by their check digit, IBANs by their
remainder, dates by the calendar, IPv4 addresses and US social security numbers by their ranges, phone numbers by their
count of digits. What is valid is permuted within its format under a key, so equal values stay equal in every document
and different ones stay different: digits become digits, letters letters of the same case, a card number keeps a right
check digit, a date stays a date of the same hundred years, written the same way. What isn't valid stays as it is. All
of it is Spark SQL expressions.

Where a card number or an IBAN ends is known only once it is valid, as a number or a word in capitals may follow it. So
both are looked for at every place first, in the widest window and in those cut shorter at its separators (an IBAN of a
known country at its length). The valid ones, and no others, then take part in the search for all candidates, and
the text after them is searched on.

A Feistel network here splits the letters and digits of a value into two halves; in each round every sign of one half is
shifted, within its class (ten digits, 26 letters), by a keyed digest of the other half. Dates and addresses are permuted
as numbers: a pair (a, b) of a mixed base in turn shifted by digests of each other. A value's kind and shape, but not its
separators, enter the digest, so 4111-1111-... and 4111 1111 ... get the same digits.

Cases: null text stays null; an empty or clean text is unchanged with 0 replacements; very long texts are read whole;
repeated rows get the same result; an empty table gives an empty result; clashing input columns (n_replaced) are
replaced, and the text column is replaced by the pseudonymised one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# labels and their number as names allow, so that no text makes the expression's recursion deep
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d\-./])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\-/]?\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\-]?\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]\d{2,4}){1,4}[ .\-]\d{2,8}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)|(?<![\w+\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\-.]?\d)"
# looked ahead for, so that windows may overlap; what stands behind a card number may follow a hyphen
IBAN_WINDOW = rf"\b(?=({IBAN[2:]}))"
CARD_WINDOW = r"(?<![\d\-])(?=(\d{13,19}(?![\-]?\d)|\d{4}[ \-]\d{6}[ \-]\d{4,5}(?![\-]?\d)|\d{4}(?:[ \-]\d{4}){3}[ \-]\d{1,3}(?!\d)|\d{4}(?:[ \-]\d{4}){3}(?!\d)|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,3}(?![\-]?\d)))"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
LOWERS, UPPERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 256)


def _number(digest: Column, at: int | Column, n: int) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("long")


def _shift(sign: Column, by: Column) -> Column:
    """A sign moved on within its class; others stay."""
    def moved(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), (_place(alphabet, sign) - 1 + by) % len(alphabet) + 1, F.lit(1))

    return F.when(sign.between("0", "9"), moved(DIGITS)).when(sign.between("a", "z"), moved(LOWERS)).when(sign.between("A", "Z"), moved(UPPERS)).otherwise(sign)


def _place(alphabet: str, sign: Column) -> Column:
    return F.instr(F.lit(alphabet), sign)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def permute_signs(value: Column, key: str, tweak: Column) -> Column:
    """The Feistel permutation of a string of letters and digits, each within its class. A single sign is shifted alone."""

    def turned(v: Column) -> Column:
        half = (F.length(v["t"]) / 2).cast("int")
        start = F.struct(F.substring(v["t"], F.lit(1), half).alias("a"), F.substring(v["t"], half + 1, F.length(v["t"])).alias("b"))

        def turn(s: Column, r: Column) -> Column:
            digest = _digest(key, tweak, v["shape"], r.cast("string"), s["b"])
            # a digest serves 16 signs; longer halves take a digest of its own for each further 16
            long = F.concat(digest, F.array_join(F.transform(F.filter(F.sequence(F.lit(0), (F.length(s["a"]) / 16).cast("int")), lambda i: i > 0), lambda i: F.sha2(F.concat(digest, i.cast("string")).cast("binary"), 256)), ""))

            def shifted(d: Column) -> Column:
                signs = F.transform(F.sequence(F.lit(1), F.length(s["a"])), lambda i: _shift(F.substring(s["a"], i, F.lit(1)), F.conv(F.substring(d, i * 4 - 3, F.lit(4)), 16, 10).cast("int")))
                return F.struct(s["b"].alias("a"), F.when(F.length(s["a"]) > 0, F.array_join(signs, "")).otherwise(F.lit("")).alias("b"))

            return let(long, shifted)

        # an even number of rounds gives the halves their own lengths back
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda d: F.concat(d["a"], d["b"]))

    shaped = lambda t: F.struct(t.alias("t"), F.translate(t, DIGITS + LOWERS + UPPERS, "0" * 10 + "a" * 26 + "A" * 26).alias("shape"))
    return let(value, lambda t: let(shaped(t), turned))


def permute_number(n: Column, a_size: Column | int, b_size: Column | int, key: str, tweak: Column) -> Column:
    """A permutation of 0 .. a_size * b_size - 1."""
    sa, sb = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a_size, b_size))
    start = F.struct((n / sb).cast("long").alias("a"), (n % sb).cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        a = (s["a"] + _number(_digest(key, tweak, r.cast("string"), F.lit("a"), s["b"].cast("string")), 1, 12)) % sa
        return let(a, lambda a: F.struct(a.alias("a"), ((s["b"] + _number(_digest(key, tweak, r.cast("string"), F.lit("b"), a.cast("string")), 1, 12)) % sb).alias("b")))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn), lambda d: d["a"] * sb + d["b"])


def _poured(shape: Column, signs: Column) -> Column:
    """signs, in turn, in the places of shape's letters and digits."""
    step = F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["out"], F.substring(signs, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
    )
    return step["out"]


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0).cast("long"),
        lambda s, i: s + F.element_at(F.array(*(F.lit(x).cast("long") for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9))), (F.substring(digits, i, F.lit(1)).cast("int") + 1 + 10 * ((F.length(digits) - i) % 2 == 0).cast("int"))),
    )


def _remainder97(signs: Column) -> Column:
    return F.aggregate(
        F.filter(F.split(signs, ""), lambda c: c != ""), F.lit(0).cast("long"),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + _place(DIGITS, c) - 1) % 97).otherwise((s * 100 + _place(UPPERS, c) + 9) % 97),
    )


def _right_card(digits: Column) -> Column:
    plain = F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) > 0  # not one digit throughout
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & plain


def _right_iban(signs: Column) -> Column:
    return F.length(signs).between(15, 34) & (_remainder97(F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, 1, 4))) == 1)


def _cards_in(text: Column) -> Column:
    """The valid card numbers: a window as a whole, or else without its last group."""
    def right(v: Column) -> Column:
        return _right_card(F.regexp_replace(v, r"[^0-9]", ""))

    cut = lambda w: F.regexp_replace(w, r"[ \-][0-9]{1,3}$", "")
    found = F.transform(F.regexp_extract_all(text, F.lit(CARD_WINDOW), F.lit(1)), lambda w: F.when(right(w), w).otherwise(let(cut(w), lambda c: F.when(right(c), c))))
    return F.filter(found, lambda v: v.isNotNull())


def _ibans_in(text: Column) -> Column:
    """The valid IBANs: a window cut to its country's length, else as a whole, or if the country isn't known the longest cut that is valid."""
    lands = F.create_map(*(F.lit(x) for n, names in IBAN_LENGTHS.items() for land in names.split() for x in (land, n)))

    def best(w: Column) -> Column:
        cuts = let(F.split(w, " "), lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws)), lambda i: F.array_join(F.slice(ws, F.lit(1), i), " ")))
        right = F.filter(cuts, lambda c: _right_iban(F.replace(c, F.lit(" "), F.lit(""))))
        own = F.try_element_at(lands, F.substring(w, 1, 2))
        exact = lambda ok: F.filter(ok, lambda c: F.length(F.replace(c, F.lit(" "), F.lit(""))) == own)
        loose = lambda ok: F.filter(ok, lambda c: own.isNull() | (c == w))
        return let(right, lambda ok: F.coalesce(F.get(exact(ok), 0), F.try_element_at(loose(ok), F.lit(-1))))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(IBAN_WINDOW), F.lit(1)), best), lambda v: v.isNotNull())


def candidates(text: Column) -> Column:
    """The regular expression of a text's candidates, with its valid card numbers and IBANs as they are; of two that begin alike the longer one first."""
    def one_of(values: Column, before: str, after: str) -> Column:
        either = F.array_join(F.reverse(F.array_sort(F.array_distinct(values))), "|")
        return let(values, lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f"{before}(?:"), either, F.lit(f"){after}|"))).otherwise(F.lit("")))

    ibans, cards = one_of(_ibans_in(text), r"\b(?=[A-Z]{2}\d)", r"\b"), one_of(_cards_in(text), r"(?<![\d\-])(?=\d{4})", r"(?!\d)")
    return F.concat(F.lit(f"{EMAIL}|"), ibans, F.lit(f"{IPV4}|{DATE}|{SSN}|"), cards, F.lit(PHONE))


def _card(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        check = lambda body: ((F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
        new = let(permute_signs(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card")), lambda body: _poured(value, F.concat(body, check(body))))
        return F.when(_right_card(digits), new).otherwise(value)

    return let(F.regexp_replace(value, r"[^0-9]", ""), made)


def _iban(value: Column, key: str) -> Column:
    def made(signs: Column) -> Column:
        body, land = F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, 1, 2)
        check = lambda new: F.lpad((F.lit(98) - _remainder97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
        new = let(permute_signs(body, key, F.concat(F.lit("iban"), land)), lambda new: _poured(value, F.concat(land, check(new), new)))
        return F.when(_right_iban(signs), new).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), made)


def _ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    n = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    written = lambda new: F.concat_ws(".", *(F.floor(new / (256**k)) % 256 for k in (3, 2, 1, 0)))
    return F.when(F.forall(octets, lambda x: x <= 255), let(permute_number(n, 65536, 65536, key, F.lit("ipv4")), written)).otherwise(value)


def _date(value: Column, key: str) -> Column:
    """Permuted among the days of its hundred years from a year ending in 50; read day first, or month first with a slash if that alone is a date."""
    parts = F.split(value, r"[\-./]")
    iso = F.substring(value, 5, 1) == "-"
    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    first, second = parts[1], parts[0]
    day_first = day(parts[2], first, second)
    month_first = F.when(F.contains(value, F.lit("/")), day(parts[2], second, first))
    swapped = ~iso & day_first.isNull() & month_first.isNotNull()
    read = F.when(iso, day(parts[0], parts[1], parts[2])).otherwise(F.coalesce(day_first, month_first))
    def within(d: Column) -> Column:
        start = F.make_date((F.floor((F.year(d) - 50) / 100) * 100 + 50).cast("int"), F.lit(1), F.lit(1))
        leap = (F.floor((F.year(d) - 50) / 100) * 100 + 100) % 400 == 0  # its hundred years have 36525 days, else 36524
        a, b = F.when(leap, 75).otherwise(92).cast("long"), F.when(leap, 487).otherwise(397).cast("long")
        new = permute_number(F.datediff(d, start).cast("long"), a, b, key, F.concat(F.lit("date"), start.cast("string")))
        return let(F.date_add(start, new.cast("int")), written)

    def written(new: Column) -> Column:
        two = F.lpad(F.day(new).cast("string"), 2, "0"), F.lpad(F.month(new).cast("string"), 2, "0")
        sign, year = F.regexp_extract(value, r"[./]", 0), F.year(new).cast("string")
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(swapped, F.concat_ws("/", two[1], two[0], year)).otherwise(F.concat(two[0], sign, two[1], sign, year))

    return let(read, lambda d: F.when(d.isNotNull() & F.year(d).between(1000, 9949), within(d)).otherwise(value))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    # 898 areas (001 to 899 without 666), 99 groups, 9999 serials
    n = ((area - 1 - (area > 666).cast("int")).cast("long") * 99 + group - 1) * 9999 + serial - 1

    def written(new: Column) -> Column:
        a = F.floor(new / (99 * 9999)) + 1
        return F.concat_ws("-", F.lpad((a + (a >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((F.floor(new / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((new % 9999 + 1).cast("string"), 4, "0"))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(permute_number(n, 898 * 99, 9999, key, F.lit("ssn")), written)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    """The country code stays, the rest of 7 to 15 digits is permuted."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    code = F.regexp_extract(value, r"^\+(\d{1,3})(?:[ .\-(])", 1)
    code = F.when((code == "") & F.startswith(value, F.lit("+")), F.substring(digits, 1, 2)).otherwise(code)
    rest = permute_signs(F.substring(digits, F.length(code) + 1, F.length(digits)), key, F.concat(F.lit("phone"), code))
    return F.when(F.length(digits).between(7, 15), _poured(value, F.concat(code, rest))).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """Names are permuted; the domain stays, as it names no person."""
    signs = F.regexp_replace(F.substring_index(value, "@", 1), r"[^A-Za-z0-9]", "")
    domain = F.lower(F.substring_index(value, "@", -1))
    new = permute_signs(signs, key, F.concat(F.lit("email"), domain))
    return F.concat(_poured(F.substring_index(value, "@", 1), new), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; the value itself if it isn't valid."""
    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key)).when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _ipv4(value, key))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"), _date(value, key)).when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(value, key))
        .when(whole(r"[A-Z]{2}\d{2}[A-Z0-9 ]+"), _iban(value, key)).when(whole(r"\d(?:[ \-]?\d){12,18}"), _card(value, key)).otherwise(_phone(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text column's personal data replaced, and n_replaced."""
    rows = docs.select(*(c for c in docs.columns if c != "n_replaced"))
    text = F.col(text_col)

    def replaced(pattern: Column) -> Column:
        """The pieces between the candidates, which are one more, and the pseudonyms in turn."""
        pour = lambda f, new: F.struct(
            F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda p, n: F.array(p, n))), "").alias("text"),
            F.aggregate(F.zip_with(f, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("n"),
        )
        found = F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(0))
        return let(found, lambda f: F.when(F.size(f) > 0, let(F.transform(f, lambda v: pseudonym(v, key)), lambda new: pour(f, new))).otherwise(same))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    # every candidate holds a digit or an @: other texts need no closer look
    made = rows.withColumn("_made", F.when(text.rlike("[0-9@]"), let(candidates(text), replaced)).otherwise(same))
    return made.select(*(F.col("_made.text").alias(c) if c == text_col else F.col(c) for c in rows.columns), F.col("_made.n").alias("n_replaced"))
