"""Model and validation queries over the numeric decks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from briefloom.functions import text as tx
from briefloom.operators import model as md
from briefloom.operators import validate as va
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.sources import corpus as c

_FIND = "CAST(deck_uid AS VARCHAR) AS deck_uid, '{sev}' AS severity, '{code}' AS code, CAST({uid} AS VARCHAR) AS uid"


def _sel(sev, code, uid):
    return _FIND.format(sev=sev, code=code, uid=uid)


COLS = ("deck_uid", "severity", "code", "uid")
NODES_SQL = """nodes AS (
  SELECT CAST(deck_uid AS VARCHAR) AS deck_uid, 'section' AS kind, section_uid AS uid FROM sections
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'slide', 's' || slide_uid FROM slides
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'block', 'b' || l_orderkey || '.' || l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT NULL, 'asset', 'a' || asset_uid FROM assets)"""


def nodes(t: c.DeckTables):
    blocks = t.blocks.join(t.slides.select("slide_uid", "deck_uid"), "slide_uid").select(
        "deck_uid", F.concat(F.lit("b"), F.col("slide_uid"), F.lit("."), F.col("line_no")).alias("uid"))
    return md.all_nodes(
        section=t.sections.select("deck_uid", F.col("section_uid").alias("uid")),
        slide=t.slides.select("deck_uid", F.concat(F.lit("s"), F.col("slide_uid")).alias("uid")),
        block=blocks, asset=t.assets.select(F.concat(F.lit("a"), F.col("asset_uid")).alias("uid")))


@query("channel_projection", b.with_(b.BLOCKS, body="""
SELECT channel, count(*) AS blocks, count(*) FILTER (is_visual) AS visuals,
       count(*) FILTER (channel = 'script') AS spoken_only, sum(units)::BIGINT AS units
FROM blocks WHERE channel IN ('slide', 'script') GROUP BY channel"""))
def channel_projection(spark, sf):
    t = c.num_blocks(spark, sf)
    both = md.on_channel(t, "slide").unionByName(md.on_channel(t, "script"))
    return both.groupBy("channel").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(md.is_visual()).alias("visuals"),
        F.count_if(md.is_spoken_only()).alias("spoken_only"), F.sum("units").alias("units"))


@query("slide_counts", b.with_(b.SLIDES, body="""
SELECT deck_uid, count(*) AS slides,
       count(*) FILTER (NOT is_backup AND role NOT IN ('cover', 'agenda', 'section', 'acknowledgement')) AS content_slides,
       count(*) FILTER (role IN ('cover', 'agenda', 'section', 'acknowledgement')) AS navigation_slides
FROM (SELECT deck_uid, is_backup, CASE WHEN slide_uid % 9 = 0 THEN 'agenda' ELSE role END AS role FROM slides)
GROUP BY deck_uid"""))
def slide_counts(spark, sf):
    s = c.num_slides(spark, sf).withColumn("role", F.when(F.col("slide_uid") % 9 == 0, "agenda").otherwise(F.col("role")))
    return md.slide_counts(s)


@query("node_paths", b.with_(b.SLIDES, b.SECTIONS, b.BLOCKS, """
si AS (SELECT deck_uid, section_uid, row_number() OVER (PARTITION BY deck_uid ORDER BY section_no) AS i FROM sections),
sj AS (SELECT slide_uid, deck_uid, section_uid,
              row_number() OVER (PARTITION BY section_uid ORDER BY slide_no) AS j FROM slides)""", body="""
SELECT block_uid, 's' || i || '.p' || j || '.b' || block_no AS path
FROM blocks JOIN sj USING (slide_uid) JOIN si USING (deck_uid, section_uid)"""))
def node_paths(spark, sf):
    t = c.deck_tables(spark, sf)
    slides = md.slide_paths(t.sections, t.slides)
    blocks = c.numbered_blocks(t.blocks.select("slide_uid", "block_uid", *c.POSITION))
    return md.block_paths(slides, blocks).select("block_uid", "path")


@query("deck_flattened", b.with_(b.SLIDES, b.SECTIONS, b.BLOCKS, body="""
SELECT deck_uid, section_no, slide_no, block_no, rubric_key, block_uid
FROM blocks JOIN slides USING (slide_uid) JOIN (SELECT section_uid, rubric_key FROM sections) USING (section_uid)"""))
def deck_flattened(spark, sf):
    t = c.deck_tables(spark, sf)
    blocks = c.numbered_blocks(t.blocks.select("slide_uid", "block_uid", *c.POSITION))
    return md.flatten_deck(t.sections, t.slides, blocks).select("deck_uid", "section_no", "slide_no", "block_no",
                                                                "rubric_key", "block_uid")


@query("nodes_found", b.with_(b.SLIDES, b.SECTIONS, b.ASSETS, NODES_SQL, body="""
SELECT n.deck_uid, n.kind, n.uid FROM nodes n
WHERE n.uid IN (SELECT 's' || o_orderkey FROM orders WHERE o_totalprice > 400000
                UNION SELECT 'a' || l_partkey FROM lineitem WHERE l_quantity >= 49)"""))
def nodes_found(spark, sf):
    t = c.deck_tables(spark, sf)
    a = c.read(spark, sf, "orders").filter("o_totalprice > 400000").select(
        F.concat(F.lit("s"), F.col("o_orderkey")).alias("uid"))
    z = c.read(spark, sf, "lineitem").filter("l_quantity >= 49").select(
        F.concat(F.lit("a"), F.col("l_partkey")).alias("uid"))
    return md.find(nodes(t), a.unionByName(z))


@query("uids_minted", """
SELECT o_orderkey, 'sld_' || substr(sha256('slide:' || o_custkey || ':' || o_orderkey), 1, 12) AS uid FROM orders""")
def uids_minted(spark, sf):
    return c.read(spark, sf, "orders").select("o_orderkey", md.mint_uid("slide", "o_custkey", "o_orderkey").alias("uid"))


@query("ancestor_pairs", b.with_(b.SLIDES, b.BLOCKS, body="""
SELECT uid, ancestor, count(*) AS n FROM (
  SELECT block_uid AS uid, unnest([CAST(slide_uid AS VARCHAR), section_uid, CAST(deck_uid AS VARCHAR)]) AS ancestor
  FROM blocks JOIN slides USING (slide_uid)
  UNION ALL
  SELECT CAST(slide_uid AS VARCHAR), unnest([section_uid, CAST(deck_uid AS VARCHAR)]) FROM slides) GROUP BY ALL"""))
def ancestor_pairs(spark, sf):
    t = c.deck_tables(spark, sf)
    return md.ancestors(t.slides, t.blocks).groupBy("uid", "ancestor").agg(F.count(F.lit(1)).alias("n"))


@query("blocks_with_assets", b.with_(b.BLOCKS, b.ASSETS, body="""
SELECT block_uid, origin, caption FROM blocks LEFT JOIN assets ON asset_ref = asset_uid"""))
def blocks_with_assets(spark, sf):
    t = c.deck_tables(spark, sf)
    return md.with_assets(t.blocks.select("block_uid", "asset_ref"),
                          t.assets.select("asset_uid", "origin", "caption")).select("block_uid", "origin", "caption")


@query("constraint_violations", """
WITH f AS (
  SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || CAST(l_quantity AS INTEGER)
           || '.' || CAST(round(l_extendedprice * 100) AS BIGINT) AS uid, l_orderkey AS slide_uid,
         CASE WHEN l_partkey % 10 = 0 THEN 'table' WHEN l_partkey % 5 = 0 THEN 'figure'
              WHEN l_partkey % 11 = 0 THEN 'equation' WHEN l_partkey % 13 = 0 THEN 'caption'
              WHEN l_partkey % 17 = 0 THEN 'note' WHEN l_partkey % 97 = 0 THEN 'poem' ELSE 'bullet' END AS type,
         CASE WHEN l_partkey % 5 = 0 AND l_partkey % 50 <> 0 THEN l_partkey END AS asset_ref,
         CASE WHEN l_suppkey % 2 = 0 THEN 'x' ELSE '' END AS content, l_linenumber AS level,
         CAST(round(l_discount * 12000) AS INTEGER) AS imp,
         CASE l_returnflag WHEN 'A' THEN 'slide' WHEN 'N' THEN 'script' ELSE 'drop' END AS channel,
         CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey || '.1' END AS bound_to,
         CASE WHEN l_partkey % 7 = 0 THEN 1 WHEN l_suppkey % 19 = 0 THEN 0 ELSE 1 END AS width
  FROM lineitem)
SELECT uid, unnest(list_filter([
  CASE WHEN type IN ('figure', 'table') AND asset_ref IS NULL THEN 'visual_needs_asset' END,
  CASE WHEN type = 'equation' AND content = '' AND asset_ref IS NULL THEN 'equation_needs_body' END,
  CASE WHEN type = 'caption' AND bound_to IS NULL THEN 'caption_needs_target' END,
  CASE WHEN type = 'note' AND channel = 'slide' THEN 'note_on_slide' END,
  CASE WHEN level > 3 THEN 'level_range' END, CASE WHEN imp > 1000 THEN 'importance_range' END,
  CASE WHEN width = 0 THEN 'span_order' END, CASE WHEN type = 'poem' THEN 'unknown_type' END],
  lambda x: x IS NOT NULL)) AS rule FROM f
UNION ALL
SELECT uid, 'caption_target_elsewhere' FROM f WHERE type = 'caption' AND bound_to IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = f.slide_uid AND k.l_linenumber = 1)""")
def constraint_violations(spark, sf):
    part, supp, line = F.col("part_key"), F.col("supp_key"), F.col("line_no")
    kind = (F.when(part % 10 == 0, "table").when(part % 5 == 0, "figure").when(part % 11 == 0, "equation")
            .when(part % 13 == 0, "caption").when(part % 17 == 0, "note").when(part % 97 == 0, "poem")
            .otherwise("bullet"))
    short = F.struct(supp.alias("doc_id"), (line * 10).alias("start"), (line * 10).alias("end"))
    f = (c.num_blocks(spark, sf).withColumn("type", kind)
         .withColumn("asset_ref", F.when((part % 5 == 0) & (part % 50 != 0), part))
         .withColumn("content", F.when(supp % 2 == 0, "x").otherwise("")).withColumn("level", line)
         .withColumn("importance_milli", F.round(F.col("importance_milli") * 1.2).cast("int"))
         .withColumn("bound_to", F.when(line % 2 == 0, F.concat("slide_uid", F.lit(".1"))))
         .withColumn("spans", F.when((part % 7 != 0) & (supp % 19 == 0), F.array(short)).otherwise(F.col("spans"))))
    targets = f.withColumn("key", F.concat("slide_uid", F.lit("."), "line_no"))
    caps = f.select("slide_uid", "block_uid", "type", "bound_to")
    here = targets.select("slide_uid", F.col("key").alias("block_uid"), F.lit("bullet").alias("type"),
                          F.lit(None).cast("string").alias("bound_to"))
    elsewhere = md.caption_targets_elsewhere(caps.unionByName(here))
    return md.block_violations(f).unionByName(elsewhere)


@query("enum_drift", """
WITH f AS (SELECT DISTINCT 'role' AS field, lower(o_orderstatus) AS member FROM orders
           UNION SELECT DISTINCT 'channel', lower(l_returnflag) FROM lineitem),
k(field, member) AS (VALUES ('role', 'f'), ('role', 'o'), ('role', 'z'), ('channel', 'a'), ('channel', 'n'))
SELECT coalesce(f.field, k.field) AS field, coalesce(f.member, k.member) AS member,
       CASE WHEN k.field IS NULL THEN 'undeclared' ELSE 'unused' END AS drift
FROM f FULL JOIN k ON f.field = k.field AND f.member = k.member WHERE f.field IS NULL OR k.field IS NULL""")
def enum_drift(spark, sf):
    roles = md.enum_drift(c.read(spark, sf, "orders").select(F.lower("o_orderstatus").alias("role")),
                          {"role": ["f", "o", "z"]})
    chans = md.enum_drift(c.read(spark, sf, "lineitem").select(F.lower("l_returnflag").alias("channel")),
                          {"channel": ["a", "n"]})
    return roles.unionByName(chans)


@query("document_metadata", b.with_(f"""
d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls, {b.strip("split_part(text, chr(10), 1)")} AS l1 FROM documents),
m AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'Property ' || doc_id
             WHEN doc_id % 3 = 1 THEN l1
             ELSE (SELECT {b.strip('x')} FROM (SELECT unnest(ls) AS x, generate_subscripts(ls, 1) AS i)
                   ORDER BY length(x) % 7 DESC, i LIMIT 1) END AS title FROM d)""", body="""
SELECT doc_id, CASE WHEN lang IN ('zh', 'en') THEN lang ELSE 'mixed' END AS language, title,
       'A' || doc_id AS presenter FROM m"""))
def document_metadata(spark, sf):
    d = c.read(spark, sf, "documents")
    ls = F.split("text", "\n")
    none = F.array().cast("array<string>")
    meta = d.select("doc_id", "lang",
                    F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Property "), "doc_id")).alias("title_property"),
                    F.concat(F.lit("A"), "doc_id", F.lit("; B、C")).alias("author_property"),
                    F.when(F.col("doc_id") % 3 == 1, F.array(tx.strip(ls[0]))).otherwise(none).alias("headings"),
                    F.transform(ls, lambda l: F.struct(l.alias("text"), (F.length(l) % 7).alias("size")))
                    .alias("first_page"))
    named = md.document_metadata(meta).join(d.select("doc_id", "lang"), "doc_id")
    return md.deck_defaults(named)


# ------------------------------------------------------------------- findings


@query("dup_uids", b.with_(b.SLIDES, b.SECTIONS, b.ASSETS, NODES_SQL, body=f"""
SELECT {_sel('error', 'DUPLICATE_UID', 'uid')}, 'uid appears ' || count(*) || ' times' AS message
FROM nodes GROUP BY deck_uid, nodes.uid HAVING count(*) > 1"""))
def dup_uids(spark, sf):
    return va.duplicate_uids(nodes(c.deck_tables(spark, sf)))


@query("dangling_assets", b.with_(b.SLIDES, b.BLOCKS, b.ASSETS, body=f"""
SELECT {_sel('error', 'DANGLING_ASSET_REF', 'block_uid')}, 'references unknown asset ' || asset_ref AS message
FROM blocks JOIN slides USING (slide_uid)
WHERE asset_ref IS NOT NULL AND asset_ref NOT IN (SELECT asset_uid FROM assets)"""))
def dangling_assets(spark, sf):
    return va.dangling_assets(c.deck_tables(spark, sf))


@query("asset_findings", b.with_(b.BLOCKS, b.ASSETS, body="""
SELECT CAST(NULL AS VARCHAR) AS deck_uid, 'warning' AS severity, 'GENERATED_ASSET' AS code,
       CAST(asset_uid AS VARCHAR) AS uid FROM assets WHERE origin = 'generated'
UNION ALL SELECT NULL, 'warning', 'ASSET_WITHOUT_PROVENANCE', CAST(asset_uid AS VARCHAR) FROM assets
  WHERE origin IN ('extracted', 'redrawn') AND NOT has_spans
UNION ALL SELECT NULL, 'info', 'ORPHAN_ASSET', CAST(asset_uid AS VARCHAR) FROM assets
  WHERE asset_uid NOT IN (SELECT asset_ref FROM blocks WHERE asset_ref IS NOT NULL)"""))
def asset_findings(spark, sf):
    return va.asset_findings(c.deck_tables(spark, sf)).select(*COLS)


SPANS_SQL = """spans AS (
  SELECT slide_uid, block_uid, supp_key AS doc_id, line_no * 10 AS s, line_no * 10 + units AS e FROM blocks WHERE n_spans > 0
  UNION ALL SELECT slide_uid, block_uid, supp_key, line_no * 10 + 100, line_no * 10 + 100 + units
    FROM blocks WHERE n_spans = 2)"""


@query("span_range", b.with_(b.SLIDES, b.BLOCKS, b.SOURCES, SPANS_SQL, body=f"""
SELECT {_sel('error', 'UNKNOWN_SOURCE_DOC', 'block_uid')}, 'span cites unregistered document ' || doc_id AS message
FROM spans JOIN slides USING (slide_uid) WHERE doc_id NOT IN (SELECT doc_id FROM sources)
UNION ALL
SELECT {_sel('error', 'SPAN_OUT_OF_RANGE', 'block_uid')},
       'span [' || s || ',' || e || ') exceeds document length ' || char_count
FROM spans JOIN sources USING (doc_id) JOIN slides USING (slide_uid) WHERE char_count > 0 AND e > char_count"""))
def span_range(spark, sf):
    return va.span_findings(c.deck_tables(spark, sf))


@query("provenance_findings", b.with_(b.SLIDES, b.BLOCKS, """
mine AS (SELECT * FROM blocks JOIN slides USING (slide_uid) WHERE derivation <> 'authored')""", body=f"""
SELECT CAST(deck_uid AS VARCHAR) AS deck_uid, CASE WHEN channel = 'slide' THEN 'error' ELSE 'warning' END AS severity,
       'UNSOURCED_CLAIM' AS code, block_uid AS uid FROM mine WHERE n_spans = 0 AND channel <> 'drop'
UNION ALL SELECT {_sel('warning', 'VERBATIM_MULTISPAN', 'block_uid')} FROM mine
  WHERE derivation = 'verbatim' AND n_spans > 1 AND asset_ref IS NULL
UNION ALL SELECT {_sel('info', 'SYNTHESIZED_SINGLE_SPAN', 'block_uid')} FROM mine
  WHERE derivation = 'synthesized' AND n_spans < 2
UNION ALL SELECT {_sel('warning', 'INFERRED_NOT_FLAGGED', 'block_uid')} FROM mine
  WHERE derivation = 'inferred' AND NOT needs_confirmation"""))
def provenance_findings(spark, sf):
    return va.provenance_findings(c.deck_tables(spark, sf)).select(*COLS)


@query("dwell_unset", b.with_(b.SLIDES, body=f"""
SELECT {_sel('info', 'DWELL_UNSET', 'deck_uid')}, count(*) || ' slide(s) have no dwell' AS message
FROM slides WHERE NOT is_backup AND dwell_seconds IS NULL GROUP BY slides.deck_uid"""))
def dwell_unset(spark, sf):
    t = c.deck_tables(spark, sf)
    return va.dwell_findings(t.decks, t.slides)


@query("dwell_mismatch", b.with_(b.SLIDES, b.DECKS, """
tot AS (SELECT deck_uid, sum(20 + slide_uid % 40) AS dwell FROM slides WHERE NOT is_backup GROUP BY deck_uid)""",
                                 body=f"""
SELECT {_sel('warning', 'DWELL_MISMATCH', 'deck_uid')}, 'dwell times sum to ' || CAST(dwell AS BIGINT) || 's' AS message
FROM tot JOIN decks USING (deck_uid)
WHERE abs(dwell - total_seconds * 0.9) > greatest(30, 0.15 * total_seconds * 0.9)"""))
def dwell_mismatch(spark, sf):
    t = c.deck_tables(spark, sf)
    slides = t.slides.withColumn("dwell_seconds", (20 + F.col("slide_uid") % 40).cast("double"))
    return va.dwell_findings(t.decks, slides)


@query("over_budget", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, """
tot AS (SELECT deck_uid, sum(units) AS spoken FROM blocks JOIN slides USING (slide_uid)
        WHERE channel IN ('slide', 'script') GROUP BY deck_uid)""", body=f"""
SELECT {_sel('warning', 'OVER_BUDGET', 'deck_uid')},
       'allocated ' || spoken || ' units against ' || (total_seconds * 900 * wpm // 60000) AS message
FROM tot JOIN decks USING (deck_uid) WHERE spoken * 5 > (total_seconds * 900 * wpm // 60000) * 6"""))
def over_budget(spark, sf):
    t = c.deck_tables(spark, sf)
    return va.over_budget(replace(t, blocks=t.blocks.withColumn("word_budget", F.col("units"))))


ALL_SECTIONS = """allsec AS (SELECT c_custkey AS deck_uid, c_custkey || ':' || i AS section_uid
  FROM customer, range(1, 6) r(i) WHERE c_custkey % 4 <> 3)"""


@query("structure_findings", b.with_(b.SLIDES, b.BLOCKS, ALL_SECTIONS, """
shown AS (SELECT slide_uid, bool_or(is_visual) AS v, bool_or(type = 'table') AS tb FROM blocks
          WHERE channel = 'slide' GROUP BY slide_uid),
s AS (SELECT * FROM slides LEFT JOIN shown USING (slide_uid))""", body=f"""
SELECT CAST(c_custkey AS VARCHAR) AS deck_uid, 'error' AS severity, 'EMPTY_DECK' AS code,
       CAST(c_custkey AS VARCHAR) AS uid FROM customer WHERE c_custkey NOT IN (SELECT deck_uid FROM allsec)
UNION ALL SELECT {_sel('warning', 'EMPTY_SECTION', 'section_uid')} FROM allsec
  WHERE section_uid NOT IN (SELECT section_uid FROM slides)
UNION ALL SELECT {_sel('warning', 'BLANK_SLIDE', 'slide_uid')} FROM s WHERE v IS NULL
UNION ALL SELECT {_sel('warning', 'ROLE_CONTENT_MISMATCH', 'slide_uid')} FROM s
  WHERE (role = 'text_figure' AND NOT coalesce(v, false)) OR (role = 'table' AND NOT coalesce(tb, false))"""))
def structure_findings(spark, sf):
    t = c.deck_tables(spark, sf)
    secs = t.decks.filter("deck_uid % 4 <> 3").select(
        "deck_uid", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).select(
        "deck_uid", F.concat_ws(":", "deck_uid", "i").alias("section_uid"))
    return va.structure_findings(replace(t, sections=secs)).select(*COLS)


GRANT = ("motivation", "objectives", "methods", "innovation", "prior_work", "feasibility", "schedule", "budget", "risks")


@query("rubric_gaps", b.with_(b.SECTIONS, body=f"""
SELECT CAST(c_custkey AS VARCHAR) AS deck_uid, 'warning' AS severity, 'RUBRIC_GAP' AS code, k AS uid,
       'no section addresses ' || k AS message
FROM customer, (SELECT unnest({list(GRANT)}) AS k) ks
WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.deck_uid = c_custkey AND s.rubric_key = k)"""))
def rubric_gaps(spark, sf):
    t = c.deck_tables(spark, sf)
    return va.rubric_gaps(t.decks, t.sections)


@query("finding_summary", b.with_(b.SLIDES, b.SECTIONS, b.DECKS, b.BLOCKS, b.ASSETS, b.SOURCES, NODES_SQL, SPANS_SQL, """
mine AS (SELECT * FROM blocks JOIN slides USING (slide_uid)),
shown AS (SELECT slide_uid, bool_or(is_visual) AS v, bool_or(type = 'table') AS tb FROM blocks
          WHERE channel = 'slide' GROUP BY slide_uid),
s AS (SELECT * FROM slides LEFT JOIN shown USING (slide_uid)),
f AS (
  SELECT deck_uid, 'error' AS sev FROM nodes GROUP BY deck_uid, uid HAVING count(*) > 1
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'error' FROM mine
    WHERE asset_ref IS NOT NULL AND asset_ref NOT IN (SELECT asset_uid FROM assets)
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'error' FROM spans JOIN slides USING (slide_uid) LEFT JOIN sources USING (doc_id)
    WHERE char_count IS NULL OR e > char_count
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), CASE WHEN channel = 'slide' THEN 'error' ELSE 'warning' END FROM mine
    WHERE derivation <> 'authored' AND n_spans = 0 AND channel <> 'drop'
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'warning' FROM mine
    WHERE derivation = 'verbatim' AND n_spans > 1 AND asset_ref IS NULL
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'info' FROM mine WHERE derivation = 'synthesized' AND n_spans < 2
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'warning' FROM mine
    WHERE derivation = 'inferred' AND NOT needs_confirmation
  UNION ALL SELECT NULL, 'warning' FROM assets WHERE origin = 'generated'
  UNION ALL SELECT NULL, 'warning' FROM assets WHERE origin IN ('extracted', 'redrawn') AND NOT has_spans
  UNION ALL SELECT NULL, 'info' FROM assets
    WHERE asset_uid NOT IN (SELECT asset_ref FROM blocks WHERE asset_ref IS NOT NULL)
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'info' FROM slides WHERE NOT is_backup
    GROUP BY deck_uid HAVING count(*) FILTER (dwell_seconds IS NULL) > 0
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'warning' FROM slides JOIN decks USING (deck_uid) WHERE NOT is_backup
    GROUP BY deck_uid, total_seconds HAVING count(*) FILTER (dwell_seconds IS NULL) = 0
      AND abs(sum(dwell_seconds) - total_seconds * 0.9) > greatest(30, 0.15 * total_seconds * 0.9)
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'warning' FROM mine JOIN decks USING (deck_uid)
    WHERE channel IN ('slide', 'script') GROUP BY deck_uid, total_seconds, wpm
    HAVING sum(units) * 5 > (total_seconds * 900 * wpm // 60000) * 6
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'error' FROM decks WHERE deck_uid NOT IN (SELECT deck_uid FROM sections)
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'warning' FROM s WHERE v IS NULL
  UNION ALL SELECT CAST(deck_uid AS VARCHAR), 'warning' FROM s
    WHERE (role = 'text_figure' AND NOT coalesce(v, false)) OR (role = 'table' AND NOT coalesce(tb, false))
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'warning'
    FROM customer, (SELECT unnest(""" + str(list(GRANT)) + """) AS k) ks
    WHERE NOT EXISTS (SELECT 1 FROM sections x WHERE x.deck_uid = c_custkey AND x.rubric_key = k))""", body="""
SELECT deck_uid, count(*) FILTER (sev = 'error') AS errors, count(*) FILTER (sev = 'warning') AS warnings,
       count(*) FILTER (sev = 'info') AS infos, count(*) FILTER (sev = 'error') = 0 AS ok FROM f GROUP BY deck_uid"""))
def finding_summary(spark, sf):
    t = c.deck_tables(spark, sf)
    t = replace(t, blocks=t.blocks.withColumn("word_budget", F.col("units")))
    return va.finding_summary(va.findings(t, nodes(t)))
