"""Language identification by Bayesian evidence fusion.

Per language a character trigram model is counted over all labelled documents; every label found is a candidate. The
driver holds 128 KB for each language, a worker the tables of BLOCK languages at once. A page's text likelihood is combined
with what its markup declares, its address suffix and a prior of its host. Those three are learnt without labels by
grouped aggregation of the pages' text posteriors: how often each language's pages declare each tag or use each suffix,
and how languages are spread over a host, smoothed towards its registered domain's spread, which is smoothed towards the
whole corpus's. A page's own vote is taken out of its host's prior.

Cases: null or empty text leaves the other evidence to decide; null html, url or tag is no evidence; a row without any
evidence gets the corpus's commonest language; without labelled documents the language is null and the score 0; very
long texts are read whole; ties go to the language that sorts first; repeated rows each vote; an empty table gives an
empty result; clashing input columns (language, confidence) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, text_batches, text_or_empty

BITS = 15  # of a trigram's hash
BLOCK = 64  # languages whose tables are held at once
GROUP_CHARS = 1 << 20  # of texts whose trigrams are held while the blocks pass
TEXT_WEIGHT = 0.25  # trigrams overlap and depend on each other, so their joint likelihood is tempered
HOST_PRIOR, DOMAIN_PRIOR, CHANNEL_PRIOR = 4.0, 10.0, 5.0  # pseudo pages of the wider spread
ADDED = ("language", "confidence")

HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>|<[^>]*>")
TAG = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)"
HOST = r"^(?s).*?://(?:[^/?#@]*@)?([^/?#:]*)"


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of letters in lower case; everything else counts as one blank between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(points, len(_LETTER) - 1)]
    points = np.where(letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    value = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    return (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)] + [True])


def visible(html: str) -> str:
    return HIDDEN.sub(" ", html)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by language and trigram, shares of rows), counted over every labelled row."""
    rows = docs.select(F.col(lang_col).alias("_l"), F.col(text_col).alias("_t")).dropna()
    found = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    if not found:
        return [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0)
    names = sorted(r["_l"] for r in found)
    at = {n: i for i, n in enumerate(names)}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}

        def counted() -> pd.DataFrame:
            which = sorted(total)
            table = np.array([total[k] for k in which]).reshape(-1, 1 << BITS)
            total.clear()
            lang, gram = np.nonzero(table)
            return pd.DataFrame({"lang": np.array(which, np.int64)[lang], "gram": gram, "n": table[lang, gram]})

        for part in parts:
            for lang, text in zip(part["_l"], part["_t"], strict=True):
                k = at[lang]
                if k not in total:
                    if len(total) == BLOCK:
                        yield counted()
                    total[k] = np.zeros(1 << BITS, np.int64)
                total[k] += np.bincount(grams(text), minlength=1 << BITS)
        yield counted()

    summed = rows.mapInPandas(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    lang, gram, n = (summed[c].to_numpy() for c in ("lang", "gram", "n"))
    whole = np.bincount(gram, n, 1 << BITS) + 0.1
    logs = np.empty((len(names), 1 << BITS), np.float32)
    for first in range(0, len(names), BLOCK):
        own = (lang >= first) & (lang < first + BLOCK)
        counts = np.zeros((len(logs[first : first + BLOCK]), 1 << BITS))
        counts[lang[own] - first, gram[own]] = n[own]
        smooth = counts + 200 * whole / whole.sum()
        logs[first : first + BLOCK] = np.log(smooth / smooth.sum(1, keepdims=True))
    of = {r["_l"]: r["n"] for r in found}
    share = np.array([of[x] for x in names], float)
    return names, logs, share / share.sum()


def likelihoods(spark: SparkSession, rows: DataFrame, text: Column, model: np.ndarray, html: bool) -> Column:
    """Tempered log likelihoods by language, relative to the best; an empty text gives zeros."""
    text_batches(spark)
    shared = [spark.sparkContext.broadcast(np.ascontiguousarray(model[k : k + BLOCK].T)) for k in range(0, len(model), BLOCK)]

    def totals(found: list[np.ndarray]) -> Iterator[list[float]]:
        """By language, of each text's trigrams."""
        out = []
        for block in shared:
            table = block.value
            out.append([np.bincount(g, minlength=len(table)).astype(np.float64) @ table if len(g) > len(table) else table[g].sum(0, dtype=np.float64) for g in found])
            if len(shared) > 1:
                block.__dict__.pop("_value", None)  # read again for the next group
        for each in zip(*out):
            total = np.concatenate(each)
            yield ((total - total.max()) * TEXT_WEIGHT).tolist()

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out, found, held = [], [], 0
            for t in part:
                found.append(grams(visible(t) if html else t) if isinstance(t, str) and t else np.zeros(0, np.int64))
                held += len(found[-1])
                if held > GROUP_CHARS:
                    out.extend(totals(found))
                    found, held = [], 0
            out.extend(totals(found))
            yield pd.Series(out)

    return score(text)


def _softmax(logs: Column) -> Column:
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _plus(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def _vote_sums(n: int, votes: str) -> Column:
    return F.array(*(F.sum(F.col(votes)[i]) for i in range(n)))


def identify(spark: SparkSession, rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str | None = None, html_col: str | None = None, url_col: str | None = None) -> DataFrame:
    """rows, without text and html, with language and confidence (its posterior probability) added. Text is text_col, or else html_col's visible text."""
    names, logs, share = model
    kept = rows.select(*(c for c in rows.columns if c not in ADDED))
    if not names:
        return kept.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    n, text = len(names), F.col(text_col or html_col)
    host = F.lower(F.regexp_extract(text_or_empty(url_col), HOST, 1)) if url_col else F.lit("")
    tag = F.lower(F.regexp_extract(text_or_empty(html_col), TAG, 1)) if html_col else F.lit("")
    tag = F.when(tag.isin(names), tag).when(tag != "", F.lit("?")).otherwise(F.lit(""))
    # the raw text isn't needed again
    slim = kept.drop(*{c for c in (text_col, html_col) if c})
    read = kept.withColumns({"_host": host, "_tag": tag, "_text": likelihoods(spark, kept, text, logs, text_col is None)})
    read = Written(spark, "language")(read.select(*slim.columns, "_host", "_tag", "_text"), "read")
    prior = F.array(*(F.lit(float(np.log(p))) for p in share))
    read = read.withColumns({
        "_domain": F.substring_index("_host", ".", -2), "_suffix": F.substring_index("_host", ".", -1), "_vote": _softmax(_plus(F.col("_text"), prior)),
    })
    if not url_col and not html_col:
        final = read.withColumn("_post", F.col("_vote"))
    else:
        total = read.agg(_vote_sums(n, "_vote").alias("_all"), F.count(F.lit(1)).alias("_n")).select(F.transform("_all", lambda x: (x + 1.0) / (F.col("_n") + float(n))).alias("_world"))
        world = total.first()  # one number for each language
        spread = F.array(*(F.lit(float(p)) for p in (world[0] if world and world[0] and world[0][0] is not None else share)))
        hosts = read.groupBy("_host", "_domain").agg(_vote_sums(n, "_vote").alias("_h"), F.count(F.lit(1)).alias("_hn"))
        domains = hosts.groupBy("_domain").agg(F.array(*(F.sum(F.col("_h")[i]) for i in range(n))).alias("_d"), F.sum("_hn").alias("_dn"))
        smoothed = domains.withColumn("_dp", F.transform(F.zip_with("_d", spread, lambda x, p: x + DOMAIN_PRIOR * p), lambda x: x / (F.col("_dn") + DOMAIN_PRIOR))).select("_domain", "_dp")
        hosts = hosts.join(smoothed, "_domain").select("_host", F.substring_index("_host", ".", -1).alias("_suffix"), "_h", "_hn", "_dp")

        def channel(key: str) -> DataFrame:
            """P(value | language), smoothed towards the value's share; values are few: known tags, or one row a suffix."""
            sums = read.filter(F.col(key) != "").groupBy(key).agg(_vote_sums(n, "_vote").alias("_s"), F.count(F.lit(1)).alias("_k"))
            whole = sums.agg(F.array(*(F.sum(F.col("_s")[i]) for i in range(n))).alias("_ws"), F.sum("_k").alias("_wk")).first()
            ws, wk = (whole[0], float(whole[1])) if whole and whole[1] else ([0.0] * n, 1.0)
            per = F.array(*(F.log((F.col("_s")[i] + CHANNEL_PRIOR * F.col("_k") / wk) / (float(ws[i]) + CHANNEL_PRIOR)) for i in range(n)))
            return sums.select(key, per.alias(f"_{key}_log"))

        none = F.array(*(F.lit(0.0) for _ in range(n)))
        hosts = hosts.join(channel("_suffix"), "_suffix", "left").drop("_suffix")
        # at most one row a language, and one for other tags
        tags = channel("_tag")
        joined = read.join(hosts, "_host", "left").join(F.broadcast(tags) if n <= BLOCK else tags, "_tag", "left")
        own = F.zip_with(F.zip_with("_h", "_vote", lambda x, v: F.greatest(x - v, F.lit(0.0))), "_dp", lambda x, p: F.log((x + HOST_PRIOR * p) / (F.col("_hn") - 1 + HOST_PRIOR)))
        base = F.transform(spread, lambda p: F.log(p))
        host_log = F.when(F.col("_host") != "", own).otherwise(base)
        final = joined.withColumn("_post", _softmax(_plus(F.col("_text"), host_log, F.coalesce("__tag_log", none), F.coalesce("__suffix_log", none))))
    best = F.array_max("_post")
    return final.select(*slim.columns, F.element_at(F.array(*map(F.lit, names)), F.array_position("_post", best).cast("int")).alias("language"), best.alias("confidence"))
