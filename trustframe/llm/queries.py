"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, html_text, licenses, merkle, ngram_join, order_minhash, pii,
               simhash, token_alignment, toxicity, urls, warc)
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def in_fold(fold: int = 0, folds: int = 5, doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) leaves ``fold``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


@_query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document, with coverage and spans."""
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), "licenses")


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "html"), ["page_id"])


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return (warc.read(spark, path, payloads=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                    "complete"))


@_query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprint of every document and of its edited text."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the held-out fold is never learnt from."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels, ~in_fold())
    return (toxicity.score(docs, model, ["doc_id"])
            .select("doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"),
                    "score", "predicted", "evidence"))


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.scan(table(spark, sf_dir, "documents", "doc_id", "text"),
                              table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id"])


@_query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every document."""
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"),
                       public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["doc_id"])


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = [F.size(pii.of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *count, F.sha2(pii.listed(base), 256).alias("base_sha256"),
                        pii.listed(F.col("pii")).alias("spans"),
                        F.transform("pii", lambda s: s["score"]).alias("scores"))


# verdict, host, start of the path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"), ("block", "example.org", "/en/1")]


@_query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    found = urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), RULES, ["page_id"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("strict_terms", "soft_terms")})


def _found_sql(terms) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END"
                     for t in sorted(terms))


ORACLE["op9_urls"] = f"""
WITH a AS (
  SELECT page_id, url, translate(url, '{urls.UPPER}', '{urls.UPPER.lower()}') AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.UPPER.lower()}'), '')
           AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_filter([{_found_sql(urls.STRICT)}], lambda x: x IS NOT NULL) AS strict_terms,
         list_filter([{_found_sql(set(urls.SOFT) - set(urls.STRICT))}], lambda x: x IS NOT NULL) AS soft_terms
  FROM a),
c AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM b)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN len(strict_terms) > 0 OR len(soft_terms) >= {urls.SOFT_HITS} THEN 'block'
            ELSE 'allow' END AS verdict,
       array_to_string(strict_terms, ',') AS strict_terms, array_to_string(soft_terms, ',') AS soft_terms
FROM c"""


@_query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proof of every document; half of them claim a text without line ends."""
    docs = table(spark, sf_dir, "documents")
    cut = F.when(in_fold(0, 2), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source",
                           "doc_id", {"text": cut})


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


def _levels_sql(name: str, levels: int) -> str:
    """``levels`` steps up the trees named ``k``: state name0 (i, h, f, p and more) to name<levels>."""
    step = """, {n}r{j} AS MATERIALIZED (
  SELECT k, i // 3 AS g, list(h ORDER BY i) AS l, sum(count(*)) OVER (PARTITION BY k) AS nodes
  FROM (SELECT DISTINCT k, i, h FROM {n}{j}) x GROUP BY 1, 2),
{n}{e} AS MATERIALIZED (
  SELECT s.* EXCLUDE (i, h, f, p), i // 3 AS i,
    CASE WHEN nodes = 1 THEN h ELSE sha256(array_to_string(l, '')) END AS h,
    CASE WHEN nodes = 1 THEN f ELSE sha256(array_to_string(l[1:i % 3] || [f] || l[i % 3 + 2:], '')) END AS f,
    CASE WHEN nodes = 1 THEN p
         ELSE p || array_to_string(l[1:i % 3], '') || array_to_string(l[i % 3 + 2:], '') END AS p
  FROM {n}{j} s JOIN {n}r{j} r ON s.k = r.k AND s.i // 3 = r.g)"""
    return "".join(step.format(n=name, j=j, e=j + 1) for j in range(levels))


# 3^14 documents of a source, 3^8 sources
ORACLE["op11_merkle"] = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
claimed AS (SELECT d.*, CASE WHEN list_reduce(
      list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295) % 2 = 1
    THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents d, crc),
s0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h AS leaf, '' AS p
  FROM (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS k,
    sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS h,
    sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "cut")))}) AS f
    FROM claimed) x){_levels_sql("s", 14)},
u0 AS MATERIALIZED (
  SELECT * EXCLUDE (i, k), h AS subroot, 0 AS k, dense_rank() OVER (ORDER BY k) - 1 AS i FROM s14)
{_levels_sql("u", 8)}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified
FROM u8"""


@_query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, weighed by corpus counts."""
    found = token_alignment.scored(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256")


@_query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of similar shingle sets of every document."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


# all pairs that share a shingle: for small tables
ORACLE["op13_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.UPPER.lower()}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
                       lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) r ON a = doc_id"""
