"""The opN queries, thin over the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, exact_dedup, html_text, language_id, mixing, near_dedup, phrases, pii, token_counts, toxicity, url_filter
from .common import Written, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


PII_KEY = "spark.tetrafield.pii.key"  # the session's setting; the query alone has a key to fall back on


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, spark.conf.get(PII_KEY, "only for trials")).select("doc_id", "text", "n_replaced")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(spark, docs, mixing.document_levels())
    return mixed.select("doc_id", "domain", F.col("lang_level").alias("lang"), F.col("source_level").alias("source"), "n_tokens", "copies")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(spark, pages).select("page_id", "url", "text", "n_chars")


def _op4_level(out: str, nodes: str, parents: str) -> str:
    """SQL of one level of water-filling."""
    return f"""
{out}_w AS (
  SELECT n.parent, n.path, n.capacity, coalesce(w.weight, 1.0) AS weight, p.budget
  FROM {nodes} n JOIN {parents} p ON n.parent = p.path LEFT JOIN weights w ON n.path = w.path),
{out}_s AS (
  SELECT *, coalesce(sum(capacity) OVER (PARTITION BY parent ORDER BY capacity / weight, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (PARTITION BY parent ORDER BY capacity / weight, path ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM {out}_w),
{out}_l AS (
  SELECT parent, arg_min((budget - filled) / weights_left, capacity / weight) FILTER (capacity * weights_left > (budget - filled) * weight) AS level
  FROM (SELECT * FROM {out}_s ORDER BY path) GROUP BY parent),
{out} AS (SELECT s.path, CASE WHEN l.level IS NULL THEN s.capacity ELSE least(s.capacity, l.level * s.weight) END AS budget
  FROM {out}_s s JOIN {out}_l l ON s.parent = l.parent)"""


OP4_SQL = rf"""
WITH weights(path, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in mixing.WEIGHTS.items())}),
rows AS (
  SELECT doc_id, regexp_extract(coalesce(source, ''), '^[^0-9]*', 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS total, sum(n_tokens)::DOUBLE * {mixing.EPOCHS} AS capacity FROM rows GROUP BY ALL),
l0 AS (SELECT '' AS path, least(floor(sum(total) * {mixing.SHARE}::DOUBLE), sum(capacity)) AS budget FROM leaves),
n1 AS (SELECT '' AS parent, domain AS path, sum(capacity) AS capacity FROM leaves GROUP BY ALL),
n2 AS (SELECT domain AS parent, domain || '/' || lang AS path, sum(capacity) AS capacity FROM leaves GROUP BY ALL),
n3 AS (SELECT domain || '/' || lang AS parent, domain || '/' || lang || '/' || source AS path, capacity FROM leaves),
{_op4_level("l1", "n1", "l0")}, {_op4_level("l2", "n2", "l1")}, {_op4_level("l3", "n3", "l2")},
plan AS (
  SELECT v.domain, v.lang, v.source, v.total, floor(round(b.budget, 3))::BIGINT AS budget,
         CASE WHEN v.total > 0 THEN least(floor(round(b.budget, 3))::BIGINT // v.total, {mixing.EPOCHS}) ELSE 0 END AS epochs
  FROM leaves v JOIN l3 b ON b.path = v.domain || '/' || v.lang || '/' || v.source),
placed AS (
  SELECT r.*, p.epochs, p.budget - p.epochs * p.total AS rest,
         sum(r.n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source
           ORDER BY md5(concat_ws('|', '{mixing.SEED}', p.epochs::VARCHAR, r.doc_id::VARCHAR)), r.doc_id ROWS UNBOUNDED PRECEDING) AS running
  FROM rows r JOIN plan p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
       (epochs + CASE WHEN epochs < {mixing.EPOCHS} AND running <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
b AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.link(spark, docs).select("doc_id", "n_shingles", "component_id", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = exact_dedup.with_digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return exact_dedup.mark(Written(spark, "exact")(docs, "digests")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()
    coded = bpe.encode(docs, path, bpe.build_lexicon(spark, docs, path))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out("doc_id"))
    scored = toxicity.score(spark, docs, toxicity.fit(spark, docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page (page_id set) and for every document (doc_id set), which has its text as the only evidence."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.fit(docs.select("text", "lang"))
    of_pages = language_id.identify(spark, pages.select("page_id", "url", "html"), model, html_col="html", url_col="url")
    of_docs = language_id.identify(spark, docs.select("doc_id", "text"), model, text_col="text")
    null = F.lit(None).cast("long")
    return of_pages.select("page_id", null.alias("doc_id"), "language", "confidence").unionByName(of_docs.select(null.alias("page_id"), "doc_id", "language", "confidence"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    made = conversations.repair(spark, rows)
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_pii": op2_pii,
    "op3_html_text": op3_html_text,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_counts": op12_token_counts,
    "op13_phrases": op13_phrases,
}
SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op5_url_filter": OP5_SQL, "op9_exact_dedup": OP9_SQL}
