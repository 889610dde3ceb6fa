"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import (
    block_rules,
    bpe_backtrack,
    context_mixing,
    imatch,
    itq_links,
    pivotal_mixing,
    rule_ensemble,
    simhash_anchors,
    spelling_trie,
    stripes,
    surrogates,
    wavelet_shards,
    weak_toxicity,
)
from lexlake.llm.common import table


def word_vocabulary() -> str:
    """Path of the public vocabulary with word ends."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_links.linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_duplicates(table(spark, sf_dir, "documents"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymised(docs)


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.scores(docs, rule_ensemble.learn(docs, table(spark, sf_dir, "labels")))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_shards.token_files(table(spark, sf_dir, "documents"), word_vocabulary())


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_toxicity.scores(docs, weak_toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_backtrack.bpe_digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pivotal_mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op11_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_rules.extracted(table(spark, sf_dir, "pages"))


def op12_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_itq_links": op1_itq_links,
    "op2_simhash_anchors": op2_simhash_anchors,
    "op3_surrogates": op3_surrogates,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_context_mixing": op5_context_mixing,
    "op6_wavelet_shards": op6_wavelet_shards,
    "op7_weak_toxicity": op7_weak_toxicity,
    "op8_bpe_backtracking": op8_bpe_backtracking,
    "op9_pivotal_mixing": op9_pivotal_mixing,
    "op10_imatch": op10_imatch,
    "op11_block_rules": op11_block_rules,
    "op12_stripes": op12_stripes,
    "op13_spelling_trie": op13_spelling_trie,
}

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, piece, row_number() OVER () AS pid
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
words AS (
  SELECT * FROM (SELECT lang, pid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i
                 FROM (SELECT lang, pid, regexp_split_to_array(piece, '[\x20\x09]+') AS ws FROM pieces))
  WHERE w1 <> ''
),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY pid ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY pid ORDER BY i) AS w3
  FROM words
),
sizes AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS f
  FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY lang, w1, w2
),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM two t
  JOIN one l ON l.lang = t.lang AND l.w1 = t.w1
  JOIN one r ON r.lang = t.lang AND r.w1 = t.w2
  LEFT JOIN longer x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
  WHERE x.f IS NULL OR 100 * x.f < 50 * t.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, l.f, r.f
  FROM three t
  JOIN one l ON l.lang = t.lang AND l.w1 = t.w1
  JOIN two r ON r.lang = t.lang AND r.w1 = t.w2 AND r.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, l.f, r.f
  FROM three t
  JOIN two l ON l.lang = t.lang AND l.w1 = t.w1 AND l.w2 = t.w2
  JOIN one r ON r.lang = t.lang AND r.w1 = t.w3
),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op12_stripes": COLLOCATIONS_SQL}
