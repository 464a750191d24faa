"""Requests in words: numbers, pages, rules and proposed edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import cues
from briefloom.operators import requests as rq
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.session import cut_lineage
from briefloom.sources import corpus as c

PHRASES = (
    "第2页太满了，把后两条放到讲稿", "整体压到8分钟", "创新点这页多给30秒", "整体做稀疏一点", "把这条改短一点", "第3页标题改成「研究方法」",
    "第99页太满了", "把这页弄好看点", "第二页拆成两页", "第1页第2条删掉", "这条一定要留在页面上", "第4页放到备用", "这两条合起来",
    "这条最重要", "研究基础太挤了", "这页配张图", "第2页的字精简一下", "把「创新」改成「亮点」", "最后三个点放到讲稿，第1页", "第1页少10秒",
    "page 2 is too full, move the last two to script", "cut the whole talk to 12 minutes", "研究条件这页太满",
)
TITLES = ("创新点", "研究基础", "研究方法", "结果分析", "创新点与成果", "计划", "")


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def slides(spark, sf):
    s = c.num_slides(spark, sf)
    from briefloom import scale

    chunk = {"__c1": F.col("section_no"), "__c2": F.floor(F.col("slide_no") / 65536)}
    s = scale.running(s, ["deck_uid"], chunk, ["section_no", "slide_no"], number="page_no", large=scale.large_groups(s, ["deck_uid"]))
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("slide_uid") % 7 + 1).cast("int"))
    return cut_lineage(s.select("deck_uid", F.col("slide_uid").cast("string").alias("slide_uid"), "page_no", title.alias("title"),
                    F.when(F.col("slide_uid") % 4 != 0, (20 + F.col("slide_uid") % 9).cast("double")).alias("dwell_seconds")))


def blocks(spark, sf, decks=None):
    """The blocks of all decks, or of all slides of the given ones."""
    d = c.num_slides(spark, sf).select("slide_uid", "deck_uid")
    only = None if decks is None else d.join(decks, "deck_uid", "left_semi").select("slide_uid")
    n = c.placed_blocks(spark, sf, None if decks is None else cut_lineage(c.large_slides(spark, sf)), only).join(d, "slide_uid")
    said = F.when(F.col("part_key") % 9 == 0, F.concat(F.lit("本研究创新"), "part_key")).otherwise(F.concat(F.lit("item "), "part_key"))
    # Read by every rule, so written once rather than derived again for each.
    return cut_lineage(n.select("deck_uid", F.col("slide_uid").cast("string").alias("slide_uid"), "block_uid", "block_no", said.alias("content"),
                    "channel", "type", "pinned", "importance_milli", F.col("asset_ref").cast("string").alias("asset_ref"),
                    F.col("units").alias("word_budget")))


def spoken_to(spark, sf):
    """The decks that somebody speaks to; no request reaches the blocks of another."""
    said = c.read(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("deck_uid"))
    return cut_lineage(c.read(spark, sf, "events").select(F.col("user_id").alias("deck_uid")).unionByName(said).distinct())


def utterances(spark, sf, s=None, bl=None):
    """A phrase per event; one in six selects a page, one in six a block, and user turns stand for plain talk."""
    s, bl = s or slides(spark, sf), bl or blocks(spark, sf, spoken_to(spark, sf))
    first_slide = s.groupBy("deck_uid").agg(F.min("slide_uid").alias("fs"))
    first_block = bl.groupBy("deck_uid").agg(F.min("block_uid").alias("fb"))
    e = F.col("event_id")
    text = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (e % len(PHRASES) + 1).cast("int"))
    r = c.read(spark, sf, "events").select(e, F.col("user_id").alias("deck_uid"), text.alias("text"))
    r = r.join(first_slide, "deck_uid", "left").join(first_block, "deck_uid", "left")
    pick = F.when((e % 6 == 0) & F.col("fs").isNotNull(), F.array("fs")).when((e % 6 == 3) & F.col("fb").isNotNull(), F.array("fb")) \
        .otherwise(F.array().cast("array<string>"))
    said = c.read(spark, sf, "conversations").filter("role = 'user'").select(
        (-1 - F.col("conv_id") * 100 - F.col("turn")).alias("utt_id"), F.col("conv_id").alias("deck_uid"), "text",
        F.array().cast("array<string>").alias("selection"))
    # Every cue reads the requests, so they are written once.
    return cut_lineage(r.select(e.alias("utt_id"), "deck_uid", "text", pick.alias("selection")).unionByName(said))


USQL = f"""rs AS (
  SELECT deck_uid, CAST(slide_uid AS VARCHAR) AS slide_uid, row_number() OVER (PARTITION BY deck_uid ORDER BY section_no, slide_no) AS page_no,
         {_sql_list(TITLES)}[slide_uid % 7 + 1] AS title, CASE WHEN slide_uid % 4 <> 0 THEN CAST(20 + slide_uid % 9 AS DOUBLE) END AS dwell
  FROM slides),
rb AS (
  SELECT rs.deck_uid, rs.slide_uid, block_uid, block_no, CASE WHEN part_key % 9 = 0 THEN '本研究创新' ELSE 'item ' END || part_key AS content,
         channel, is_visual, pinned, importance_milli, asset_ref, units AS word_budget
  FROM blocks JOIN rs ON rs.slide_uid = CAST(blocks.slide_uid AS VARCHAR)),
utt AS (
  SELECT event_id AS utt_id, user_id AS deck_uid, {_sql_list(PHRASES)}[event_id % {len(PHRASES)} + 1] AS text,
         CASE WHEN event_id % 6 = 0 AND fs IS NOT NULL THEN fs WHEN event_id % 6 = 3 AND fb IS NOT NULL THEN fb END AS pick
  FROM events LEFT JOIN (SELECT deck_uid, min(slide_uid) AS fs FROM rs GROUP BY 1) a ON a.deck_uid = user_id
  LEFT JOIN (SELECT deck_uid, min(block_uid) AS fb FROM rb GROUP BY 1) b ON b.deck_uid = user_id
  UNION ALL SELECT -1 - conv_id * 100 - turn, conv_id, {b.strip('text')}, NULL FROM conversations WHERE role = 'user'),
num AS (
  SELECT *, CASE WHEN regexp_matches(text, '第[0-9]+页') THEN CAST(regexp_extract(text, '第([0-9]+)页', 1) AS INTEGER)
              WHEN regexp_matches(text, '第[一二两三四五六七八九十]+页') THEN
                list_position(['一', '二', '三', '四', '五', '六', '七', '八', '九', '十'], regexp_extract(text, '第([一二两三四五六七八九十]+)页', 1))
              WHEN regexp_matches(text, '(?i)(page|slide) *[0-9]+') THEN CAST(regexp_extract(text, '(?i)(?:page|slide) *([0-9]+)', 1) AS INTEGER) END AS page,
         CASE WHEN regexp_matches(text, '第[0-9]+条') THEN CAST(regexp_extract(text, '第([0-9]+)条', 1) AS INTEGER) END AS item,
         CASE WHEN contains(text, '后两条') THEN 2 WHEN contains(text, '最后三个') THEN 3 WHEN contains(lower(text), 'last two') THEN 2 END AS n_take,
         CASE WHEN regexp_matches(text, '[0-9]+分钟') THEN 60 * CAST(regexp_extract(text, '([0-9]+)分钟', 1) AS INTEGER)
              WHEN regexp_matches(text, '[0-9]+ minutes') THEN 60 * CAST(regexp_extract(text, '([0-9]+) minutes', 1) AS INTEGER)
              WHEN regexp_matches(text, '[0-9]+秒') THEN CAST(regexp_extract(text, '([0-9]+)秒', 1) AS INTEGER) END AS seconds FROM utt)"""

RESOLVE = """tm AS (
  SELECT u.utt_id, len(s.title) AS l, count(*) AS n, min(s.slide_uid) AS sid FROM num u JOIN rs s ON s.deck_uid = u.deck_uid
  WHERE s.title <> '' AND contains(u.text, s.title) GROUP BY 1, 2),
tb AS (SELECT utt_id, arg_max(n, l) AS n, arg_max(sid, l) AS sid FROM tm GROUP BY 1),
ph AS (SELECT utt_id, deck_uid, unnest(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}')) AS p FROM num),
pm AS (SELECT ph.utt_id, arg_min(s.slide_uid, s.page_no) AS sid FROM ph JOIN rs s ON s.deck_uid = ph.deck_uid AND s.title <> '' AND contains(s.title, ph.p) GROUP BY 1),
sl AS (SELECT utt_id, coalesce(s.slide_uid, k.slide_uid) AS sid FROM num u LEFT JOIN rs s ON s.slide_uid = u.pick LEFT JOIN rb k ON k.block_uid = u.pick WHERE u.pick IS NOT NULL),
res AS (
  SELECT u.*, CASE WHEN sl.sid IS NOT NULL THEN sl.sid WHEN page IS NOT NULL THEN pn.slide_uid WHEN tb.n > 1 THEN NULL WHEN tb.sid IS NOT NULL THEN tb.sid ELSE pm.sid END AS slide_uid,
         CASE WHEN sl.sid IS NOT NULL THEN 100 WHEN page IS NOT NULL THEN CASE WHEN pn.slide_uid IS NULL THEN 0 ELSE 95 END WHEN tb.n > 1 THEN 0 WHEN tb.sid IS NOT NULL THEN 80
              WHEN pm.sid IS NOT NULL THEN 65 ELSE 0 END AS pct,
         CASE WHEN sl.sid IS NOT NULL THEN 'selection' WHEN page IS NOT NULL THEN CASE WHEN pn.slide_uid IS NULL THEN 'no such page' ELSE 'page number' END WHEN tb.n > 1 THEN 'several titles match'
              WHEN tb.sid IS NOT NULL THEN 'title' WHEN pm.sid IS NOT NULL THEN 'part of a title' ELSE 'no page named' END AS why
  FROM num u LEFT JOIN sl USING (utt_id) LEFT JOIN tb USING (utt_id) LEFT JOIN pm USING (utt_id)
  LEFT JOIN rs pn ON pn.deck_uid = u.deck_uid AND pn.page_no = u.page)"""


def facts(spark, sf):
    s, bl = slides(spark, sf), blocks(spark, sf, spoken_to(spark, sf))
    return cut_lineage(rq.request_facts(utterances(spark, sf, s, bl), s, bl)), s, bl


@query("utterance_numbers", b.with_(b.SLIDES, b.BLOCKS, USQL, body="SELECT utt_id, page, item, n_take, seconds FROM num"))
def utterance_numbers(spark, sf):
    u = utterances(spark, sf)
    return u.select("utt_id", cues.ordinal("text", "页").alias("page"), cues.ordinal("text", "条").alias("item"),
                    cues.count_phrase("text").alias("n_take"), cues.duration_seconds("text").alias("seconds"))


@query("resolve_slide", b.with_(b.SLIDES, b.BLOCKS, USQL, RESOLVE, body="SELECT utt_id, slide_uid, pct AS slide_pct, why AS slide_why FROM res"))
def resolve_slide(spark, sf):
    s, bl = slides(spark, sf), blocks(spark, sf, spoken_to(spark, sf))
    return rq.resolve_slide(utterances(spark, sf, s, bl), s, bl).select("utt_id", "slide_uid", "slide_pct", "slide_why")


@query("title_mentions", b.with_(b.SLIDES, b.BLOCKS, USQL, RESOLVE, body="""
SELECT utt_id, CASE WHEN n = 1 THEN sid END AS slide_uid, n > 1 AS ambiguous FROM tb"""))
def title_mentions(spark, sf):
    return rq.title_mentions(utterances(spark, sf), slides(spark, sf))


def _any(words, x="text"):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


FACTS = """sb AS (
  SELECT u.utt_id, k.* FROM num u JOIN rb k ON k.block_uid = u.pick
  UNION ALL SELECT u.utt_id, k.* FROM num u JOIN rb k ON k.slide_uid = u.pick),
sf AS (SELECT utt_id, count(*) AS n_sel, count(*) FILTER (pinned) AS sel_pin, count(*) FILTER (NOT is_visual) AS sel_text FROM sb GROUP BY 1),
pf AS (SELECT slide_uid, count(*) FILTER (channel = 'slide') AS n_on, count(*) FILTER (channel = 'slide' AND NOT is_visual) AS n_body,
              count(*) FILTER (channel = 'slide' AND NOT is_visual AND pinned) AS n_pin, bool_or(asset_ref IS NOT NULL) AS has_asset FROM rb GROUP BY 1),
body AS (SELECT *, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no) AS body_no, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no DESC) AS tail_no,
                row_number() OVER (PARTITION BY slide_uid ORDER BY pinned, importance_milli, block_no) AS weak_no FROM rb WHERE channel = 'slide' AND NOT is_visual),
onp AS (SELECT *, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no) AS on_no FROM rb WHERE channel = 'slide'),
tp AS (SELECT r.utt_id, count(*) AS n FROM res r JOIN body k ON k.slide_uid = r.slide_uid AND k.tail_no <= r.n_take WHERE k.pinned GROUP BY 1),
sub AS (
  SELECT u.utt_id, 'set_text' AS op, k.block_uid AS target, replace(k.content, '创新', '亮点') AS value FROM num u JOIN rb k ON k.deck_uid = u.deck_uid
    WHERE u.text = '把「创新」改成「亮点」' AND contains(k.content, '创新')
  UNION ALL SELECT u.utt_id, 'set_title', s.slide_uid, replace(s.title, '创新', '亮点') FROM num u JOIN rs s ON s.deck_uid = u.deck_uid
    WHERE u.text = '把「创新」改成「亮点」' AND contains(s.title, '创新')),
su AS (SELECT utt_id, count(*) AS n FROM sub GROUP BY 1),
ft AS (
  SELECT r.*, coalesce(n_sel, 0) AS n_sel, coalesce(sel_pin, 0) AS sel_pin, coalesce(sel_text, 0) AS sel_text, coalesce(n_on, 0) AS n_on, coalesce(n_body, 0) AS n_body,
         coalesce(n_pin, 0) AS n_pin, coalesce(has_asset, false) AS has_asset, coalesce(tp.n, 0) AS take_pin, coalesce(su.n, 0) AS n_sub, s.dwell
  FROM res r LEFT JOIN sf USING (utt_id) LEFT JOIN pf ON pf.slide_uid = r.slide_uid LEFT JOIN tp USING (utt_id) LEFT JOIN su USING (utt_id)
  LEFT JOIN rs s ON s.slide_uid = r.slide_uid),
""" + f"""rd AS (
  SELECT *, {_any(cues.WHOLE_TALK)} OR NOT ({_any(cues.THIS_PAGE)} OR page IS NOT NULL) AS whole FROM ft),
ru AS (
  SELECT utt_id, unnest(list_filter([
    CASE WHEN text = '把「创新」改成「亮点」' THEN CASE WHEN n_sub > 0 THEN {{'n': 1, 'r': 'replace_text', 'p': 95, 'ok': true}} ELSE {{'n': 1, 'r': 'replace_text', 'p': 30, 'ok': false}} END END,
    CASE WHEN seconds IS NOT NULL THEN CASE WHEN whole AND seconds < 60 THEN {{'n': 2, 'r': 'retime', 'p': 40, 'ok': false}} WHEN whole THEN {{'n': 2, 'r': 'retime', 'p': 95, 'ok': true}}
      WHEN slide_uid IS NULL THEN {{'n': 2, 'r': 'retime', 'p': 30, 'ok': false}} ELSE {{'n': 2, 'r': 'retime', 'p': least(92, pct), 'ok': true}} END END,
    CASE WHEN {_any(cues.TOO_FULL)} OR {_any(cues.TO_SCRIPT, 'lower(text)')} THEN
      CASE WHEN n_sel > 0 AND sel_pin > 0 THEN {{'n': 3, 'r': 'declutter', 'p': 50, 'ok': false}} WHEN n_sel > 0 AND sel_text = 0 THEN {{'n': 3, 'r': 'declutter', 'p': 40, 'ok': false}}
           WHEN n_sel > 0 THEN {{'n': 3, 'r': 'declutter', 'p': 95, 'ok': true}} WHEN slide_uid IS NULL THEN {{'n': 3, 'r': 'declutter', 'p': 30, 'ok': false}}
           WHEN n_take IS NULL AND n_body <= 1 THEN {{'n': 3, 'r': 'declutter', 'p': 40, 'ok': false}}
           WHEN n_take IS NULL AND greatest(1, n_body // 3) > n_body - n_pin THEN {{'n': 3, 'r': 'declutter', 'p': 50, 'ok': false}}
           WHEN n_take IS NULL THEN {{'n': 3, 'r': 'declutter', 'p': 70, 'ok': true}} WHEN take_pin > 0 THEN {{'n': 3, 'r': 'declutter', 'p': 50, 'ok': false}}
           WHEN n_body = 0 THEN {{'n': 3, 'r': 'declutter', 'p': 40, 'ok': false}} ELSE {{'n': 3, 'r': 'declutter', 'p': 90, 'ok': true}} END END,
    CASE WHEN {_any(cues.SHORTEN, 'lower(text)')} AND NOT (coalesce(seconds, 0) > 0 AND {_any(cues.WHOLE_TALK_SHORT)}) THEN
      CASE WHEN n_sel > 0 AND sel_text > 0 THEN {{'n': 4, 'r': 'shorten', 'p': 90, 'ok': true}} WHEN n_sel > 0 OR slide_uid IS NULL OR n_body = 0 THEN {{'n': 4, 'r': 'shorten', 'p': 30, 'ok': false}}
           ELSE {{'n': 4, 'r': 'shorten', 'p': least(90, pct), 'ok': true}} END END,
    CASE WHEN contains(text, '标题') OR contains(lower(text), 'title') THEN CASE WHEN NOT regexp_matches(text, '[「『"“''][^」』"”'']{{1,40}}[」』"”'']') THEN {{'n': 5, 'r': 'set_title', 'p': 40, 'ok': false}}
      WHEN slide_uid IS NULL THEN {{'n': 5, 'r': 'set_title', 'p': 30, 'ok': false}} ELSE {{'n': 5, 'r': 'set_title', 'p': least(93, pct), 'ok': true}} END END,
    CASE WHEN {_any(cues.SPLIT)} THEN CASE WHEN slide_uid IS NULL THEN {{'n': 6, 'r': 'split_slide', 'p': 30, 'ok': false}} WHEN n_on < 2 THEN {{'n': 6, 'r': 'split_slide', 'p': 40, 'ok': false}}
      ELSE {{'n': 6, 'r': 'split_slide', 'p': least(90, pct), 'ok': true}} END END,
    CASE WHEN {_any(cues.MERGE)} THEN CASE WHEN n_sel < 2 THEN {{'n': 7, 'r': 'merge', 'p': 35, 'ok': false}} ELSE {{'n': 7, 'r': 'merge', 'p': 90, 'ok': true}} END END,
    CASE WHEN {_any(cues.DELETE)} AND NOT {_any(cues.TO_SCRIPT)} THEN CASE WHEN n_sel > 0 THEN {{'n': 8, 'r': 'delete', 'p': 90, 'ok': true}} WHEN slide_uid IS NULL THEN {{'n': 8, 'r': 'delete', 'p': 30, 'ok': false}}
      WHEN item IS NULL OR item NOT BETWEEN 1 AND n_on THEN {{'n': 8, 'r': 'delete', 'p': 35, 'ok': false}} ELSE {{'n': 8, 'r': 'delete', 'p': 85, 'ok': true}} END END,
    CASE WHEN {_any(cues.KEEP)} THEN CASE WHEN n_sel > 0 THEN {{'n': 9, 'r': 'pin', 'p': 90, 'ok': true}} WHEN slide_uid IS NULL OR n_on = 0 THEN {{'n': 9, 'r': 'pin', 'p': 30, 'ok': false}}
      ELSE {{'n': 9, 'r': 'pin', 'p': 70, 'ok': true}} END END,
    CASE WHEN {_any(cues.IMPORTANT)} THEN CASE WHEN n_sel > 0 THEN {{'n': 10, 'r': 'emphasise', 'p': 85, 'ok': true}} ELSE {{'n': 10, 'r': 'emphasise', 'p': 35, 'ok': false}} END END,
    CASE WHEN {_any(cues.RESERVE)} THEN CASE WHEN slide_uid IS NOT NULL THEN {{'n': 11, 'r': 'backup', 'p': least(90, pct), 'ok': true}} ELSE {{'n': 11, 'r': 'backup', 'p': 30, 'ok': false}} END END,
    CASE WHEN {_any(cues.WITH_FIGURE)} THEN CASE WHEN slide_uid IS NULL THEN {{'n': 12, 'r': 'figure_layout', 'p': 30, 'ok': false}} WHEN NOT has_asset THEN {{'n': 12, 'r': 'figure_layout', 'p': 50, 'ok': false}}
      ELSE {{'n': 12, 'r': 'figure_layout', 'p': least(85, pct), 'ok': true}} END END,
    CASE WHEN {_any(cues.SPARSER)} OR {_any(cues.DENSER)} OR {_any(cues.SPARSER, 'lower(text)')} OR {_any(cues.DENSER, 'lower(text)')} THEN {{'n': 13, 'r': 'density', 'p': 85, 'ok': true}} END
  ], lambda x: x IS NOT NULL)) AS z FROM rd WHERE text <> ''),
pick AS (SELECT utt_id, arg_min(z, CASE WHEN z.ok AND z.p >= 95 THEN z.n ELSE 100000 - z.p * 100 + z.n END) AS z FROM ru GROUP BY utt_id)"""


@query("rule_readings", b.with_(b.SLIDES, b.BLOCKS, USQL, RESOLVE, FACTS, body="""
SELECT utt_id, z.n AS rule_no, z.r AS rule, z.p AS pct, z.ok AS ok FROM ru"""))
def rule_readings(spark, sf):
    return rq.rule_readings(facts(spark, sf)[0]).select("utt_id", "rule_no", "rule", "pct", "ok")


@query("rule_pick", b.with_(b.SLIDES, b.BLOCKS, USQL, RESOLVE, FACTS, body="""
SELECT u.utt_id, u.deck_uid, coalesce(z.r, 'no rule matched') AS rule, coalesce(z.p, 0) AS confidence_pct, coalesce(z.ok, false) AS ok
FROM num u LEFT JOIN pick USING (utt_id)"""))
def rule_pick(spark, sf):
    return rq.interpret(facts(spark, sf)[0])


@query("edits_proposed", b.with_(b.SLIDES, b.BLOCKS, USQL, RESOLVE, FACTS, """
w AS (SELECT f.*, z.r AS rule FROM rd f JOIN pick USING (utt_id) WHERE z.ok)""", body="""
SELECT utt_id, 'retime' AS op, CAST(deck_uid AS VARCHAR) AS target, CAST(seconds AS VARCHAR) AS value FROM w WHERE rule = 'retime' AND whole
UNION ALL SELECT utt_id, 'set_dwell', slide_uid, CAST(CASE WHEN contains(text, '多给') AND dwell > 0 THEN dwell + seconds
    WHEN contains(text, '少') AND dwell > 0 THEN greatest(5.0, dwell - seconds) ELSE CAST(seconds AS DOUBLE) END AS VARCHAR) FROM w WHERE rule = 'retime' AND NOT whole
UNION ALL SELECT utt_id, 'set_title', slide_uid, '研究方法' FROM w WHERE rule = 'set_title'
UNION ALL SELECT utt_id, 'set_backup', slide_uid, 'true' FROM w WHERE rule = 'backup'
UNION ALL SELECT utt_id, 'set_slide_role', slide_uid, 'text_figure' FROM w WHERE rule = 'figure_layout'
UNION ALL SELECT utt_id, 'retime', CAST(deck_uid AS VARCHAR), 'sparse' FROM w WHERE rule = 'density'
UNION ALL SELECT s.utt_id, s.op, s.target, s.value FROM sub s JOIN w USING (utt_id) WHERE rule = 'replace_text'
UNION ALL SELECT w.utt_id, CASE rule WHEN 'declutter' THEN 'set_channel' WHEN 'shorten' THEN 'rewrite' WHEN 'delete' THEN 'delete_block' WHEN 'pin' THEN 'pin' ELSE 'set_importance' END,
    k.block_uid, CASE rule WHEN 'declutter' THEN 'script' WHEN 'shorten' THEN nullif(CAST(k.word_budget * 67 // 100 AS VARCHAR), '0') WHEN 'delete' THEN 'drop' WHEN 'pin' THEN 'true' ELSE '1000' END
  FROM w JOIN sb k USING (utt_id) WHERE rule IN ('delete', 'pin', 'emphasise') OR (rule IN ('declutter', 'shorten') AND NOT k.is_visual)
UNION ALL SELECT w.utt_id, 'pin', k.block_uid, 'true' FROM w JOIN sb k USING (utt_id) WHERE rule = 'emphasise'
UNION ALL SELECT w.utt_id, 'merge_blocks', f.block_uid, k.block_uid FROM w JOIN sb k USING (utt_id)
  JOIN (SELECT utt_id, arg_min(block_uid, block_no) AS block_uid FROM sb GROUP BY 1) f ON f.utt_id = w.utt_id WHERE rule = 'merge' AND k.block_uid <> f.block_uid
UNION ALL SELECT w.utt_id, 'set_channel', k.block_uid, 'script' FROM w JOIN body k ON k.slide_uid = w.slide_uid
  WHERE rule = 'declutter' AND n_sel = 0 AND CASE WHEN n_take IS NOT NULL THEN k.tail_no <= n_take ELSE k.weak_no <= greatest(1, n_body // 3) END
UNION ALL SELECT w.utt_id, 'rewrite', k.block_uid, nullif(CAST(k.word_budget * 67 // 100 AS VARCHAR), '0') FROM w JOIN body k ON k.slide_uid = w.slide_uid
  WHERE rule = 'shorten' AND n_sel = 0 AND CASE WHEN item BETWEEN 1 AND n_body THEN k.body_no = item ELSE true END
UNION ALL SELECT w.utt_id, 'delete_block', k.block_uid, 'drop' FROM w JOIN onp k ON k.slide_uid = w.slide_uid AND k.on_no = w.item WHERE rule = 'delete' AND n_sel = 0
UNION ALL SELECT w.utt_id, 'pin', k.block_uid, 'true' FROM w JOIN onp k ON k.slide_uid = w.slide_uid WHERE rule = 'pin' AND n_sel = 0
UNION ALL SELECT w.utt_id, 'split_slide', w.slide_uid, k.block_uid FROM w JOIN onp k ON k.slide_uid = w.slide_uid AND k.on_no = (n_on - 1) // 2 + 1 WHERE rule = 'split_slide'"""))
def edits_proposed(spark, sf):
    f, s, bl = facts(spark, sf)
    return rq.propose(f, rq.interpret(f), s, bl)
