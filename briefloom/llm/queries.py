"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm import bpe, collisions, decontam, fingerprints, neardup, negatives, pii, preferences, prefixtrie, quality, secrets, toxicity, urls
from briefloom.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    lexicon = toxicity.learn(docs, table(spark, folder, "labels", ["doc_id", "toxic"]))
    return toxicity.score(docs, lexicon).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


@query("op3_bpe")
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_WORDS = ", ".join(f"'{w}'" for w in urls.SPAM_WORDS)
_FITS = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
                 for r, _ in sorted(RULES, key=lambda x: -len(x[0])))


@query("op4_url_filter", f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts),
fit AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)} END
            WHEN list_has_any(string_split(replace(replace(host, '-', '.'), '_', '.'), '.'), [{_WORDS}]) THEN 'block'
            ELSE 'allow' END AS verdict
FROM fit""")
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages", ["page_id", "url"]), RULES)


@query("op5_preferences", """
WITH turns AS (
  SELECT conv_id AS pair, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, 'unknown'), coalesce(text, '')) AS position
  FROM conversations),
ends AS (SELECT *, max(CASE WHEN role = 'assistant' THEN position END) OVER (PARTITION BY pair) AS last,
                lag(text) OVER (PARTITION BY pair ORDER BY position) AS said FROM turns),
kept AS (SELECT *, CASE WHEN position = last THEN coalesce(said, '') ELSE text END AS other FROM ends WHERE last IS NULL OR position <= last),
cut AS (SELECT *, min(CASE WHEN text <> other THEN position END) OVER (PARTITION BY pair) AS split FROM kept),
parts AS (
  SELECT pair, CASE WHEN split IS NULL OR position < split THEN 'prompt' ELSE 'chosen' END AS part, position, role,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM cut
  UNION ALL
  SELECT pair, 'rejected', position, role, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) FROM cut WHERE position >= split)
SELECT pair AS conv_id, part, position, role, rendered,
       CAST(sum(length(rendered)) OVER w - length(rendered) AS BIGINT) AS "start", CAST(sum(length(rendered)) OVER w AS BIGINT) AS "end",
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS train
FROM parts WINDOW w AS (PARTITION BY pair, part ORDER BY position)""")
def op5_preferences(spark: SparkSession, folder: str) -> DataFrame:
    chosen, rejected = preferences.parroted(table(spark, folder, "conversations", ["conv_id", "turn", "role", "text"]))
    return preferences.format_pairs(chosen, rejected).withColumnRenamed("pair", "conv_id")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents", ["doc_id", "text"]))


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    return quality.with_quality(docs, quality.learn(docs)).drop("text")


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(table(spark, folder, "documents", ["doc_id", "text"])).drop("rowkey")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    found = decontam.with_matches(docs, table(spark, folder, "benchmark", ["item_id", "text"])).drop("text")
    return found.withColumn("contaminated", F.size("bench_items") > 0)


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, folder, "documents", ["doc_id", "text"]))


@query("op10_pii")
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scanned(table(spark, folder, "documents", ["doc_id", "text"]))


@query("op11_hard_negatives", """
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.row <> b.row),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS no FROM scored WHERE same QUALIFY no <= 5),
windowed AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.no ORDER BY n.score DESC, n.vec_id) AS rank,
         n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score,
       CAST(negative_score AS BIGINT) AS negative_score FROM windowed""")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", ["vec_id", "embedding", "label"])
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


@query("op12_prefix_trie", """
WITH told AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS position,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(d ORDER BY position) AS d, list(n ORDER BY position) AS n FROM told GROUP BY conv_id),
sized AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.d, 1, c.h), []), list_slice(c.d, c.h + 1, len(c.d))) AS d,
         list_concat(coalesce(list_slice(b.n, 1, c.h), []), list_slice(c.n, c.h + 1, len(c.n))) AS n
  FROM sized c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
steps AS (SELECT *, unnest(range(len(d) + 1)) AS depth FROM built),
visits AS (SELECT conv_id, depth, array_to_string(list_slice(d, 1, depth), ',') AS key, array_to_string(list_slice(d, 1, depth - 1), ',') AS above,
                  CASE WHEN depth = 0 THEN 0 ELSE n[depth] END AS n, depth = len(d) AS stops FROM steps),
nodes AS (
  SELECT key, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
         coalesce(string_agg(CASE WHEN stops THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM visits GROUP BY key),
kids AS (SELECT p.key, count(c.key) AS n_children FROM nodes p LEFT JOIN nodes c ON c.depth > 0 AND c.above = p.key GROUP BY p.key),
marked AS (SELECT nodes.*, n_children FROM nodes JOIN kids USING (key)),
trees AS (
  SELECT a.key, count(CASE WHEN b.n_children = 0 THEN 1 END) AS n_leaves, sum((b.n_convs - 1) * b.n) AS saved_tokens
  FROM marked a JOIN marked b ON b.depth >= a.depth AND starts_with(b.key, a.key) GROUP BY a.key)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM marked m JOIN trees t USING (key) LEFT JOIN nodes p ON m.depth > 0 AND p.key = m.above""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.trie(table(spark, folder, "conversations", ["conv_id", "turn", "role", "text"]))


@query("op13_collision_neighbours")
def op13_collision_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.neighbours(table(spark, folder, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 20 == 0)
