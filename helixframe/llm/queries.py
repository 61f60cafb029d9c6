"""Registered queries over the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.decontaminate import contaminated
from helixframe.llm.langid import identify_languages
from helixframe.llm.lexical import rank_documents
from helixframe.llm.media import media_digests
from helixframe.llm.neardup import near_duplicates
from helixframe.llm.negatives import mine_negatives
from helixframe.llm.packing import pack
from helixframe.llm.pii import find_personal_data
from helixframe.llm.quality import score_quality
from helixframe.llm.secrets import find_secrets
from helixframe.llm.simhash import near_duplicates_by_fingerprint
from helixframe.llm.tokencount import count_tokens
from helixframe.llm.urlfilter import PATTERNS, filter_urls, listed_rule
from helixframe.storage import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The rules that op5 is given.
OP5_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), [*(listed_rule(*r) for r in OP5_RULES), *PATTERNS])


ORACLES["op5_url_filter"] = f"""
WITH cut AS (
  SELECT row_number() OVER () AS k, page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
parts AS (
  SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM cut),
pages_cut AS (SELECT k, page_id, host, regexp_extract(tail, '^[^?#]*') AS path, host || tail AS target FROM parts),
rules(action, rule) AS (VALUES {", ".join(f"('{a}', '{r}')" for a, r in OP5_RULES)}),
split AS (SELECT action, rule, split_part(rule, '/', 1) AS rhost, substr(rule, instr(rule, '/')) AS rpath FROM rules),
best AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM pages_cut JOIN split ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, CASE
  WHEN {" OR ".join(f"regexp_matches(target, '{p.pattern}')" for p in PATTERNS if p.action == "allow")} THEN 'allow'
  WHEN {" OR ".join(f"regexp_matches(target, '{p.pattern}')" for p in PATTERNS if p.action == "block")} THEN 'block'
  ELSE 'allow' END) AS verdict
FROM pages_cut LEFT JOIN best USING (k)
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


@query
def op2_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


@query
def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


@query
def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op13_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine_negatives(turned, F.col("vec_id") % 100 == 0)


ORACLES["op13_four_russians_negatives"] = """
WITH rows_of AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, a.label AS own, b.k, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_of a JOIN rows_of b ON a.vec_id % 100 = 0 AND a.k <> b.k),
positives AS (
  SELECT anchor, anchor_id, own, k AS pos, vec_id AS positive_id, score AS positive_score FROM pairs WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, pos ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor = p.anchor AND n.label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query
def op12_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_by_fingerprint(table(spark, sf_dir, "documents"))


@query
def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_range_maximum_search"] = r"""
WITH item_terms AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)) GROUP BY ALL),
doc_terms AS MATERIALIZED (
  SELECT doc, doc_id, term, count(*) AS tf FROM (
    SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)) GROUP BY ALL),
sizes AS (SELECT doc, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY doc),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM doc_terms, total WHERE term IN (SELECT term FROM item_terms) GROUP BY term, docs),
impacts AS (
  SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))) AS impact
  FROM doc_terms JOIN weights USING (term) JOIN sizes USING (doc), total),
scored AS (SELECT item, item_id, doc, doc_id, sum(times * impact)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY ALL HAVING sum(times * impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored QUALIFY rank <= 20
"""
