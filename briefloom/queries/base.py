"""SQL text shared by the checks: the same projections, written for DuckDB."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
IDEOGRAPH = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
SPACED = (r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}"
          r"\x{3000}-\x{303f}\x{fe30}-\x{fe4f}\x{ff00}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}]")


def units(x: str) -> str:
    """Units of ``x``: tokens holding a letter or digit, plus ideographs."""
    return (f"(len(list_filter(regexp_split_to_array(regexp_replace({x}, '{SPACED}', ' ', 'g'), '{SPACE}+'), "
            f"lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) + len(regexp_extract_all({x}, '{IDEOGRAPH}')))")


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def sentence_list(x: str, marks: str = ".!?;") -> str:
    cut = f"string_split(regexp_replace({x}, '([{marks}。！？；]){SPACE}*', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def clause_list(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([，,；;])', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter({cut}, lambda s: {strip('s')} <> '')"


LINES = """lines AS (
  SELECT doc_id, source AS deck_uid, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS slide_no
  FROM documents)"""

SENTS = LINES + f""",
sent_lists AS (SELECT doc_id, deck_uid, slide_no, {sentence_list('line')} AS ss FROM lines),
sents AS (SELECT doc_id, deck_uid, slide_no, unnest(ss) AS content,
                 CAST(generate_subscripts(ss, 1) AS BIGINT) AS block_no FROM sent_lists)"""

DECKS = """decks AS (
  SELECT c_custkey AS deck_uid, 300 + 60 * (c_custkey % 10) AS total_seconds, 210 AS wpm,
         CASE c_custkey % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'balanced' ELSE 'compact' END AS density,
         CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 9 END AS max_bullets,
         CASE c_custkey % 3 WHEN 0 THEN 18 WHEN 1 THEN 28 ELSE 42 END AS bullet_units,
         CASE c_custkey % 3 WHEN 0 THEN 72 WHEN 1 THEN 168 ELSE 378 END AS slide_cap,
         CASE c_custkey % 3 WHEN 0 THEN 70 WHEN 1 THEN 45 ELSE 20 END AS script_pct,
         CASE c_custkey % 3 WHEN 0 THEN 550 WHEN 1 THEN 350 ELSE 180 END AS demote_below,
         CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS max_level
  FROM customer)"""

SLIDES = """slides AS (
  SELECT o_custkey AS deck_uid, o_custkey || ':' || substr(o_orderpriority, 1, 1) AS section_uid,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS section_no,
         [2000, 1600, 1400, 1200, 600][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS weight_milli,
         o_orderkey AS slide_uid, o_orderkey AS slide_no,
         CASE o_orderstatus WHEN 'F' THEN 'text_dense' WHEN 'O' THEN 'text_figure' ELSE 'table' END AS role,
         o_orderkey % 11 = 0 AS is_backup, o_orderkey % 13 = 0 AS dwell_locked,
         CASE WHEN o_orderkey % 13 = 0 THEN 20.0 END AS dwell_seconds
  FROM orders)"""

SECTIONS = """sections AS (
  SELECT DISTINCT o_custkey AS deck_uid, o_custkey || ':' || substr(o_orderpriority, 1, 1) AS section_uid,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS section_no,
         ['innovation', 'methods', 'objectives', 'motivation', 'schedule'][
           CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS rubric_key
  FROM orders)"""

BLOCKS = """blocks AS (
  SELECT l_orderkey AS slide_uid,
         l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' ||
           CAST(l_quantity AS INTEGER) || '.' || CAST(round(l_extendedprice * 100) AS BIGINT) AS block_uid,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS block_no,
         l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key,
         CAST(l_quantity AS INTEGER) AS units,
         CASE WHEN l_partkey % 10 = 0 THEN 'table' WHEN l_partkey % 5 = 0 THEN 'figure' ELSE 'bullet' END AS type,
         l_partkey % 5 = 0 AS is_visual,
         CASE WHEN l_partkey % 5 = 0 THEN l_partkey END AS asset_ref, l_linenumber % 4 AS level,
         ['verbatim', 'compressed', 'synthesized', 'inferred', 'authored'][l_suppkey % 5 + 1] AS derivation,
         CAST(round(l_discount * 10000) AS INTEGER) AS importance_milli,
         CASE l_returnflag WHEN 'A' THEN 'slide' WHEN 'N' THEN 'script' ELSE 'drop' END AS channel,
         l_linenumber = 1 AS pinned, l_linenumber % 2 = 0 AS needs_confirmation,
         CASE WHEN l_partkey % 7 = 0 THEN 0 WHEN l_linenumber = 2 THEN 2 ELSE 1 END AS n_spans,
         l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS span_end
  FROM lineitem)"""

ASSETS = """assets AS (
  SELECT p_partkey AS asset_uid,
         CASE p_type WHEN 'ECONOMY' THEN 'extracted' WHEN 'SMALL' THEN 'redrawn' WHEN 'MEDIUM' THEN 'authored'
                     WHEN 'PROMO' THEN 'generated' WHEN 'STANDARD' THEN 'extracted' ELSE 'redrawn' END AS origin,
         p_partkey % 7 <> 0 AS has_spans, p_name AS caption
  FROM part WHERE p_size <= 45)"""

SOURCES = """sources AS (
  SELECT s_suppkey AS doc_id, 60 + s_suppkey % 60 AS char_count FROM supplier WHERE s_suppkey % 20 <> 0)"""

EDITS = """edits AS (
  SELECT user_id AS deck_uid, event_id AS seq, 1 AS op_no, event_id AS patch_id, ts AS created_at,
         CASE event_type WHEN 'click' THEN 'set_importance' WHEN 'view' THEN 'pin'
              WHEN 'purchase' THEN 'set_channel' WHEN 'error' THEN 'delete_block' ELSE 'retime' END AS op,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS target,
         CASE event_type WHEN 'click' THEN CAST(CAST(round(value * 2) AS BIGINT) AS VARCHAR) WHEN 'view' THEN 'true'
              WHEN 'purchase' THEN ['slide', 'script', 'drop'][event_id % 3 + 1] WHEN 'error' THEN 'drop'
              ELSE CAST(300 + event_id % 600 AS VARCHAR) END AS value,
         event_id % 100 AS confidence_pct
  FROM events)"""


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
