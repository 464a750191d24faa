"""Budget queries over the numeric decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.operators import budget as bg
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.sources import corpus as c

CLOCK = """clock AS (
  SELECT d.deck_uid, d.density, max_bullets, bullet_units, slide_cap, script_pct, demote_below, max_level,
         total_seconds * 900 AS effective_milli, total_seconds * 900 * wpm // 60000 AS total_units,
         greatest(1, CAST(round_even(total_seconds * 900 / 45000.0, 0) AS BIGINT)) AS target_slides,
         coalesce(locked_milli, 0) AS locked_milli, coalesce(locked_slides, 0) AS locked_slides,
         coalesce(open_slides, 0) AS open_slides, coalesce(content_slides, 0) AS content_slides,
         greatest(0, total_seconds * 900 - coalesce(locked_milli, 0)) AS open_milli
  FROM decks d LEFT JOIN (
    SELECT deck_uid, count(*) FILTER (dwell_locked) * 20000 AS locked_milli,
           count(*) FILTER (dwell_locked) AS locked_slides, count(*) FILTER (NOT dwell_locked) AS open_slides,
           count(*) AS content_slides
    FROM slides WHERE NOT is_backup GROUP BY deck_uid) x USING (deck_uid))"""

MASS = """mass AS (
  SELECT slide_uid, CASE WHEN sum(m) > 0 THEN sum(m) ELSE 600 END AS mass FROM (
    SELECT slide_uid, CAST(round(greatest(importance_milli, 50) * CASE WHEN is_visual THEN 6 ELSE 10 END
           * sqrt(greatest(units, CASE WHEN is_visual THEN 6 ELSE 1 END))) AS BIGINT) AS m
    FROM blocks WHERE channel <> 'drop') GROUP BY slide_uid)"""

SHARES = """shares AS (
  SELECT s.deck_uid, s.slide_uid, s.section_uid, s.role, s.dwell_locked AS locked, s.dwell_seconds,
         CASE WHEN s.dwell_locked THEN 0 ELSE CAST(weight_milli AS HUGEINT) * coalesce(mass, 600) END AS share
  FROM slides s LEFT JOIN mass USING (slide_uid) WHERE NOT is_backup),
timed AS (
  SELECT *, CASE WHEN locked THEN 0 ELSE total_units * share // total END AS units FROM (
    SELECT x.*, c.* EXCLUDE (deck_uid), sum(share) OVER (PARTITION BY x.deck_uid) AS total
    FROM shares x JOIN clock c ON c.deck_uid = x.deck_uid)),
planned AS (
  SELECT deck_uid, slide_uid, section_uid, role, locked, max_bullets, bullet_units, demote_below, max_level, open_slides,
         CASE WHEN locked THEN dwell_seconds
              ELSE (2 * open_milli * share + 100 * total) // (200 * total) / 10.0 END AS dwell_out,
         CASE WHEN open_slides = 0 THEN 0 WHEN locked THEN slide_cap
              ELSE least(units - units * script_pct // 100, slide_cap) END AS page,
         CASE WHEN locked THEN 0 ELSE units * script_pct // 100 END AS script FROM timed)"""


def position() -> tuple[str, ...]:
    return c.POSITION


@query("deck_budget", b.with_(b.SLIDES, b.DECKS, CLOCK, body="""
SELECT deck_uid, effective_milli, total_units, target_slides FROM clock"""))
def deck_budget(spark, sf):
    return bg.deck_budget(c.num_decks(spark, sf)).select("deck_uid", "effective_milli", "total_units", "target_slides")


@query("density_profiles", b.with_(b.DECKS, body="""
SELECT density, count(*) AS decks, max(max_bullets) AS max_bullets, max(bullet_units) AS bullet_units,
       max(slide_cap) AS slide_cap, max(script_pct) AS script_pct, max(demote_below) AS demote_below,
       max(max_level) AS max_level, count(*) FILTER (slide_cap < max_bullets * bullet_units) AS conflicts
FROM decks GROUP BY density"""))
def density_profiles(spark, sf):
    d = c.num_decks(spark, sf).withColumns(bg.profile_columns())
    conflict = F.count_if(F.col("slide_cap") < F.col("max_bullets") * F.col("bullet_units")).alias("conflicts")
    names = ("max_bullets", "bullet_units", "slide_cap", "script_pct", "demote_below", "max_level")
    return d.groupBy("density").agg(F.count(F.lit(1)).alias("decks"), *[F.max(n).alias(n) for n in names], conflict)


@query("section_weights", b.with_(b.SECTIONS, body="""
SELECT section_uid, CASE rubric_key WHEN 'innovation' THEN 2000 WHEN 'methods' THEN 1600 WHEN 'objectives' THEN 1400
   WHEN 'motivation' THEN 1200 ELSE 500 END AS weight_milli, rubric_key = 'schedule' AS is_backup
FROM sections"""))
def section_weights(spark, sf):
    s = c.num_sections(spark, sf).withColumn("rubric_key", F.when(F.col("rubric_key") == "schedule", "budget").otherwise(
        F.col("rubric_key")))
    return bg.section_weights(s).select("section_uid", "weight_milli", "is_backup")


@query("slide_mass", b.with_(b.BLOCKS, MASS, body="SELECT slide_uid, CAST(mass AS BIGINT) AS mass FROM mass"))
def slide_mass(spark, sf):
    return bg.slide_mass(c.num_blocks(spark, sf))


@query("time_share", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, body="""
SELECT deck_uid, slide_uid, CAST(dwell_out AS DOUBLE) AS dwell_out, CAST(page AS BIGINT) AS slide_units,
       CAST(script AS BIGINT) AS script_units FROM planned"""))
def time_share(spark, sf):
    t = c.deck_tables(spark, sf)
    return bg.time_share(t.decks, t.slides, bg.slide_mass(t.blocks)).select(
        "deck_uid", "slide_uid", "dwell_out", "slide_units", "script_units")


@query("capacity_clamp", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, """
cap AS (SELECT o_orderkey AS slide_uid, 20 + o_orderkey % 90 AS cap FROM orders WHERE o_orderkey % 3 <> 0)""", body="""
SELECT slide_uid, CAST(CASE WHEN open_slides = 0 THEN 0 ELSE least(page, coalesce(cap, page)) END AS BIGINT) AS slide_units,
       CAST(CASE WHEN locked THEN 0 ELSE script + greatest(0, page - coalesce(cap, page)) END AS BIGINT) AS script_units
FROM planned LEFT JOIN cap USING (slide_uid)"""))
def capacity_clamp(spark, sf):
    t = c.deck_tables(spark, sf)
    cap = t.slides.filter("slide_uid % 3 <> 0").select("slide_uid", (20 + F.col("slide_uid") % 90).alias("text_capacity"),
                                                       F.lit(0).alias("bullet_lines"))
    return bg.time_share(t.decks, t.slides, bg.slide_mass(t.blocks), cap).select("slide_uid", "slide_units",
                                                                               "script_units")


@query("drift_notes", b.with_(b.SLIDES, b.DECKS, CLOCK, body="""
SELECT deck_uid, unnest(list_filter([
    CASE WHEN locked_milli > effective_milli THEN 'locked_exceeds_time' END,
    CASE WHEN open_slides = 0 AND locked_slides > 0 THEN 'all_locked' END,
    CASE WHEN open_slides = 0 AND locked_slides = 0 THEN 'nothing_to_allocate' END,
    CASE WHEN open_slides > 0 AND content_slides > target_slides THEN 'too_many_slides' END,
    CASE WHEN open_slides > 0 AND content_slides < target_slides THEN 'room_for_more' END],
    lambda x: x IS NOT NULL)) AS note, content_slides, target_slides, content_slides - target_slides AS drift
FROM clock"""))
def drift_notes(spark, sf):
    t = c.deck_tables(spark, sf)
    return bg.drift_notes(t.decks, t.slides)


@query("long_slides", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, """
w AS (SELECT deck_uid, slide_uid, CAST(round(dwell_out * 10) AS BIGINT) AS tenths FROM planned),
x AS (SELECT *, CAST(sum(tenths) OVER (PARTITION BY deck_uid) AS BIGINT) AS whole FROM w)""", body="""
SELECT deck_uid, slide_uid, tenths, whole FROM x WHERE whole > 0 AND tenths * 100 >= whole * 22"""))
def long_slides(spark, sf):
    t = c.deck_tables(spark, sf)
    timed = bg.time_share(t.decks, t.slides, bg.slide_mass(t.blocks))
    return bg.long_slides(timed).select("deck_uid", "slide_uid", "tenths", "whole")


@query("thin_slides", b.with_(b.SLIDES, b.BLOCKS, """
sh AS (SELECT slide_uid FROM blocks GROUP BY slide_uid HAVING count(*) FILTER (is_visual) = 0
        AND count(*) FILTER (NOT is_visual AND channel = 'slide' AND units > 0) = 1),
th AS (SELECT deck_uid, slide_uid, count(*) OVER (PARTITION BY deck_uid) AS run FROM slides JOIN sh USING (slide_uid)
       WHERE NOT is_backup)""", body="SELECT * FROM th WHERE run >= 3"))
def thin_slides(spark, sf):
    t = c.deck_tables(spark, sf)
    return bg.thin_slides(t.slides, t.blocks)


@query("estimate_duration", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, """
u AS (SELECT deck_uid, sum(units) AS units FROM blocks JOIN slides USING (slide_uid)
      WHERE NOT is_backup AND channel <> 'drop' GROUP BY deck_uid)""", body="""
SELECT deck_uid, CAST(coalesce(units, 0) AS BIGINT) AS units,
       round(coalesce(units, 0) * 60 / 210.0, 3)::DOUBLE AS spoken,
       round(coalesce(units, 0) * 60 / 210.0 / total_seconds, 4)::DOUBLE AS fit
FROM decks LEFT JOIN u USING (deck_uid)"""))
def estimate_duration(spark, sf):
    t = c.deck_tables(spark, sf)
    return bg.estimate_duration(t.decks, t.slides, t.blocks)


# The allocation written block by block, as an independent check of the bins.
ALLOC = """
cand AS (
  SELECT b.*, p.deck_uid, p.section_uid, p.max_bullets, p.bullet_units, p.demote_below, p.max_level, p.page, p.script,
         greatest(importance_milli, 50) AS w,
         type = 'bullet' AND channel = 'slide' AS bullet_on
  FROM blocks b JOIN planned p USING (slide_uid) WHERE channel <> 'drop' AND open_slides > 0),
ranked AS (
  SELECT *, count(*) FILTER (bullet_on) OVER (PARTITION BY slide_uid) - max_bullets AS overflow,
         row_number() OVER (PARTITION BY slide_uid, bullet_on, pinned ORDER BY importance_milli, block_no) AS rnk
  FROM cand),
stepa AS (
  SELECT *, bullet_on AND NOT pinned AND (rnk <= overflow OR importance_milli < demote_below) AS out1 FROM ranked),
stepb AS (
  SELECT *, count(*) FILTER (channel = 'slide' AND NOT out1) OVER (PARTITION BY slide_uid) AS on_page,
         row_number() OVER (PARTITION BY slide_uid ORDER BY importance_milli DESC, block_no) AS best FROM stepa),
stepc AS (
  SELECT *, on_page = 0 AND best = 1 AS back,
         CASE WHEN on_page = 0 AND best = 1 THEN 'slide' WHEN out1 THEN 'script' ELSE channel END AS ch FROM stepb),
pages AS (
  SELECT slide_uid, any_value(page) AS page, any_value(script) AS script, any_value(bullet_units) AS cap,
         list(w ORDER BY block_no) FILTER (NOT is_visual AND ch = 'slide') AS ws,
         list(block_uid ORDER BY block_no) FILTER (NOT is_visual AND ch = 'slide') AS ids
  FROM stepc GROUP BY slide_uid),
spill AS (SELECT slide_uid, ws, ids, cap, CAST(least(page, cap * greatest(coalesce(len(ws), 0), 1)) AS BIGINT) AS pool,
                 CAST(script + page - least(page, cap * greatest(coalesce(len(ws), 0), 1)) AS BIGINT) AS script FROM pages),
"""


def rounds(name: str, source: str) -> str:
    """Apportionment rounds as a recursive query; keeps the blocks of a slide as lists."""
    live_total = "list_sum(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN live[i] THEN ws[i] ELSE 0 END))"
    grant = (f"list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN live[i] THEN "
             f"greatest(0, least(pool * ws[i] // tot, cap - got[i])) ELSE 0 END)")
    return f"""
{name}_r AS (
  SELECT slide_uid, ws, ids, cap, pool, list_transform(ws, lambda x: 0::BIGINT) AS got,
         list_transform(ws, lambda x: true) AS live, 0 AS step FROM {source} WHERE len(ws) > 0
  UNION ALL
  SELECT slide_uid, ws, ids, cap, CAST(pool - list_sum(g) AS BIGINT),
         list_transform(range(1, len(ws) + 1), lambda i: CAST(got[i] + g[i] AS BIGINT)),
         list_transform(range(1, len(ws) + 1), lambda i: live[i] AND g[i] > 0 AND got[i] + g[i] < cap), step + 1
  FROM (SELECT *, {grant} AS g FROM (SELECT *, {live_total} AS tot FROM {name}_r WHERE pool > 0 AND list_bool_or(live)))),
{name} AS (SELECT slide_uid, unnest(ids) AS block_uid, unnest(got) AS units FROM {name}_r
           QUALIFY row_number() OVER (PARTITION BY slide_uid ORDER BY step DESC) = 1)"""


FULL = ALLOC + rounds("pg", "spill") + """,
stepd AS (
  SELECT s.*, pg.units AS page_units, NOT is_visual AND ch = 'slide' AND NOT pinned AND coalesce(pg.units, 0) < 6 AS frag
  FROM stepc s LEFT JOIN pg USING (slide_uid, block_uid)),
stepe AS (SELECT *, CASE WHEN frag THEN 'script' ELSE ch END AS channel_out FROM stepd),
spoken AS (
  SELECT e.slide_uid, list(w ORDER BY block_no) AS ws, list(block_uid ORDER BY block_no) AS ids,
         any_value(greatest(cap * 4, 120)) AS cap, any_value(spill.script) AS pool
  FROM stepe e JOIN spill USING (slide_uid) WHERE channel_out = 'script' GROUP BY e.slide_uid),""" + rounds(
    "sp", "spoken")


@query("allocate_blocks", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, FULL, recursive=True, body="""
SELECT e.slide_uid, e.block_uid, channel_out, (out1 OR frag) AND (NOT back OR frag) AS demoted, back AS reinstated,
       least(level, max_level) AS level_out,
       CAST(CASE WHEN channel_out = 'script' THEN greatest(coalesce(sp.units, 0), 6)
                 WHEN NOT is_visual THEN greatest(coalesce(page_units, 0), 6) END AS BIGINT) AS word_budget
FROM stepe e LEFT JOIN sp USING (slide_uid, block_uid)"""))
def allocate_blocks(spark, sf):
    t = c.deck_tables(spark, sf)
    _, blocks = bg.allocate(t.decks, t.slides, t.blocks, position())
    return blocks.select("slide_uid", "block_uid", "channel_out", "demoted", "reinstated", "level_out",
                         F.col("word_budget").cast("long").alias("word_budget"))


@query("allocate_slides", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, ALLOC.rstrip().rstrip(","), body="""
SELECT p.slide_uid, CAST(coalesce(s.pool, p.page) AS BIGINT) AS slide_units,
       CAST(coalesce(s.script, p.script) AS BIGINT) AS script_units, coalesce(len(ws), 0) AS n_targets
FROM planned p LEFT JOIN spill s USING (slide_uid) WHERE open_slides > 0 AND s.slide_uid IS NOT NULL"""))
def allocate_slides(spark, sf):
    t = c.deck_tables(spark, sf)
    plan, _ = bg.allocate(t.decks, t.slides, t.blocks, position())
    filled = bg.with_kind(t.blocks, position()).select("slide_uid")
    return (plan.filter("open_slides > 0").join(filled, "slide_uid", "left_semi")
            .select("slide_uid", "slide_units", "script_units", "n_targets"))


@query("allocated_rollup", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, body="""
SELECT deck_uid, section_uid, CAST(sum(page + script) AS BIGINT) AS allocated, count(*) AS slides
FROM planned GROUP BY ROLLUP (deck_uid, section_uid)"""))
def allocated_rollup(spark, sf):
    t = c.deck_tables(spark, sf)
    return bg.allocated_units(bg.time_share(t.decks, t.slides, bg.slide_mass(t.blocks)))


@query("what_if_grid", b.with_(b.SLIDES, b.BLOCKS, MASS, """
grid AS (SELECT deck_uid, secs, dens, secs * 900 AS eff, CASE dens WHEN 'sparse' THEN 72 ELSE 378 END AS cap, CASE dens WHEN 'sparse' THEN 70 ELSE 20 END AS pct
         FROM (SELECT c_custkey AS deck_uid FROM customer), (SELECT unnest([480, 900]) AS secs),
              (SELECT unnest(['sparse', 'compact']) AS dens)),
held AS (SELECT deck_uid, count(*) FILTER (NOT dwell_locked) AS open_slides FROM slides WHERE NOT is_backup GROUP BY deck_uid),
sh AS (SELECT deck_uid, slide_uid, dwell_locked AS locked, open_slides, CASE WHEN dwell_locked THEN 0 ELSE CAST(weight_milli AS HUGEINT) * coalesce(mass, 600) END AS share
       FROM slides LEFT JOIN mass USING (slide_uid) JOIN held USING (deck_uid) WHERE NOT is_backup),
t AS (SELECT *, sum(share) OVER (PARTITION BY deck_uid) AS total FROM sh),
u AS (SELECT t.*, secs, dens, cap, pct, CASE WHEN locked OR total = 0 THEN 0 ELSE eff * 210 // 60000 * share // total END AS units FROM t JOIN grid USING (deck_uid))""", body="""
SELECT secs || '/' || dens AS variant, count(*) AS slides, count(*) FILTER (locked) AS locked_slides,
       CAST(sum(CASE WHEN open_slides = 0 THEN 0 WHEN locked THEN cap ELSE least(units - units * pct // 100, cap) END) AS BIGINT) AS page,
       CAST(sum(CASE WHEN locked THEN 0 ELSE units * pct // 100 END) AS BIGINT) AS script
FROM u GROUP BY 1"""))
def what_if_grid(spark, sf):
    """The same decks under four timings; pages with a fixed time keep it in all of them."""
    t = c.deck_tables(spark, sf)
    decks = bg.what_if(t.decks, [480, 900], ["sparse", "compact"])
    key = F.concat_ws("|", "deck_uid", "variant")
    slides = t.slides.join(decks.select("deck_uid", "variant"), "deck_uid").withColumn("deck_uid", key).drop("variant")
    timed = bg.time_share(decks.withColumn("deck_uid", key), slides, bg.slide_mass(t.blocks))
    return timed.groupBy("variant").agg(F.count(F.lit(1)).alias("slides"), F.count_if("locked").alias("locked_slides"),
                                        F.sum("slide_units").alias("page"), F.sum("script_units").alias("script"))


@query("demotion_notes", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, CLOCK, MASS, SHARES, ALLOC.rstrip().rstrip(","), body="""
SELECT slide_uid, count(*) FILTER (out1 AND NOT back) AS demoted, count(*) FILTER (back) AS reinstated,
       bool_or(on_page = 0) AS was_empty
FROM stepc GROUP BY slide_uid"""))
def demotion_notes(spark, sf):
    t = c.deck_tables(spark, sf)
    _, blocks = bg.allocate(t.decks, t.slides, t.blocks, position())
    # Fragments leave the page later, for want of units, and are not part of this count.
    return blocks.groupBy("slide_uid").agg(
        F.count_if(F.col("cap_demoted") & ~F.col("reinstated")).alias("demoted"),
        F.count_if("reinstated").alias("reinstated"), F.bool_or("reinstated").alias("was_empty"))
