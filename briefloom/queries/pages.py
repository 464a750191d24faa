"""Template, geometry, pointing and rendered-page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import measure as ms
from briefloom.functions import shapes as sh
from briefloom.functions import text as tx
from briefloom.operators import layouts as ly
from briefloom.operators import pages as pg
from briefloom.operators import pointing as pt
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.queries.structure import DOCLINES, doc_lines
from briefloom.sources import corpus as c

ROLE_SETS = (("text_dense", "summary"), ("text_figure", "big_figure"), ("two_column",), ("text_dense", "agenda"),
             ("cover", "section"), ("big_figure",))


def layouts(spark, sf):
    n = F.col("n_nationkey")
    roles = F.element_at(F.array(*[F.array(*[F.lit(r) for r in rs]) for rs in ROLE_SETS]), (n % 6 + 1).cast("int"))
    return c.read(spark, sf, "nation").select(
        F.col("n_regionkey").alias("template_id"), n.alias("layout_id"), n.alias("layout_no"),
        F.concat(F.when(n % 7 == 0, "Vertical ").when(n % 7 == 1, "Figure page ").otherwise("Layout "), n).alias("name"),
        roles.alias("roles"))


def slots(spark, sf):
    n = F.col("n_nationkey")

    def slot(i, kind, y, w, h, units, lines):
        return F.struct(F.lit(i).alias("slot_id"), F.lit(kind).alias("kind"), F.lit(0.05).alias("x"),
                        y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"),
                        units.cast("int").alias("capacity_units"), lines.cast("int").alias("capacity_lines"))

    low = F.when(n % 5 == 3, 0.6).otherwise(0.05)
    parts = F.array_compact(F.array(
        slot(1, "title", low, F.lit(0.9), F.lit(0.1), 20 + n, F.lit(1)),
        slot(2, "body", F.lit(0.2), 0.4 + 0.02 * (n % 10), F.lit(0.5), F.when(n % 8 != 7, 100 + 10 * (n % 9)), 5 + n % 4),
        F.when(n % 3 == 0, slot(3, "figure", F.lit(0.2), F.lit(0.3), F.lit(0.4), F.lit(None), F.lit(None))),
        F.when(n % 4 == 0, slot(4, "body", F.lit(0.7), 0.2 + 0.01 * n, F.lit(0.3), F.lit(50), F.lit(4)))))
    return c.read(spark, sf, "nation").select(F.col("n_regionkey").alias("template_id"), n.alias("layout_id"),
                                              F.explode(parts).alias("s")).select("template_id", "layout_id", "s.*")


LAYOUTS = """layouts AS (
  SELECT n_regionkey AS template_id, n_nationkey AS layout_id, n_nationkey AS layout_no,
         CASE n_nationkey % 7 WHEN 0 THEN 'Vertical ' WHEN 1 THEN 'Figure page ' ELSE 'Layout ' END || n_nationkey AS name,
         [['text_dense', 'summary'], ['text_figure', 'big_figure'], ['two_column'], ['text_dense', 'agenda'],
          ['cover', 'section'], ['big_figure']][n_nationkey % 6 + 1] AS roles, n_nationkey AS n FROM nation),
slots AS (
  SELECT template_id, layout_id, 1 AS slot_id, 'title' AS kind, CASE WHEN n % 5 = 3 THEN 0.6 ELSE 0.05 END::DOUBLE AS y,
         0.9::DOUBLE AS w, 0.1::DOUBLE AS h, 20 + n AS units, 1 AS lines FROM layouts
  UNION ALL SELECT template_id, layout_id, 2, 'body', 0.2, 0.4::DOUBLE + 0.02::DOUBLE * (n % 10), 0.5,
         CASE WHEN n % 8 <> 7 THEN 100 + 10 * (n % 9) END, 5 + n % 4 FROM layouts
  UNION ALL SELECT template_id, layout_id, 3, 'figure', 0.2, 0.3, 0.4, NULL, NULL FROM layouts WHERE n % 3 = 0
  UNION ALL SELECT template_id, layout_id, 4, 'body', 0.7, 0.2::DOUBLE + 0.01::DOUBLE * n, 0.3, 50, 4 FROM layouts WHERE n % 4 = 0),
feat AS (
  SELECT l.*, f.* EXCLUDE (template_id, layout_id), contains(lower(name), 'vertical') AS vertical FROM layouts l JOIN (
    SELECT template_id, layout_id, count(*) FILTER (kind = 'body') AS bodies, count(*) FILTER (kind = 'figure') AS figures,
           coalesce(max(w * h) FILTER (kind = 'figure'), 0) AS fig_area, coalesce(max(w * h) FILTER (kind = 'body'), 0) AS body_area,
           coalesce(sum(w * h) FILTER (kind = 'body'), 0) AS text_area,
           CAST(coalesce(sum(units) FILTER (kind = 'body'), 0) AS BIGINT) AS body_units,
           CAST(coalesce(sum(units) FILTER (kind IN ('body', 'title')), 0) AS BIGINT) AS text_units,
           coalesce(max(coalesce(lines, 0)) FILTER (kind = 'body'), 0) AS lines, max(units) FILTER (kind = 'title') AS title_units,
           min(y) FILTER (kind = 'title') > 0.45 AS low_title, count(*) FILTER (units IS NULL) AS unmeasured
    FROM slots GROUP BY ALL) f USING (template_id, layout_id))"""

NEEDS = """needs AS (
  SELECT s.*, s.deck_uid % 5 AS template_id,
         CASE WHEN s.slide_uid % 4 = 0 THEN 'cover' WHEN s.slide_uid % 9 = 0 THEN 'equation' ELSE s.role END AS brole,
         CASE WHEN s.slide_uid % 29 = 0 THEN CAST(s.slide_uid % 25 AS INTEGER) END AS layout_hint,
         coalesce(v, 0) AS wv, least(coalesce(t, 0), 5) AS wt
  FROM slides s LEFT JOIN (SELECT slide_uid, count(*) FILTER (is_visual) AS v, count(*) FILTER (NOT is_visual) AS t
                           FROM blocks WHERE channel = 'slide' GROUP BY slide_uid) x USING (slide_uid)),
fb(role, alt, prio) AS (VALUES ('cover', 'section', 0), ('cover', 'text_dense', 1), ('text_dense', 'two_column', 0),
  ('text_dense', 'summary', 1), ('text_dense', 'agenda', 2), ('text_figure', 'two_column', 0), ('text_figure', 'big_figure', 1),
  ('text_figure', 'text_dense', 2), ('table', 'big_figure', 0), ('table', 'text_figure', 1), ('table', 'text_dense', 2),
  ('equation', 'text_dense', 0), ('equation', 'big_figure', 1)),
cand AS (
  SELECT n.slide_uid, n.layout_hint, n.wv, n.wt, f.*, list_contains(f.roles, n.brole) AS exact,
         (SELECT min(prio) FROM fb WHERE fb.role = n.brole AND list_contains(f.roles, fb.alt)) AS prio,
         CASE WHEN wv > 0 AND wt > 0 AND figures + bodies >= wv + 1 THEN 1 ELSE 0 END AS s1, -(wv - least(figures, wv)) AS s2,
         CASE WHEN vertical THEN 1 ELSE 0 END AS s3, CASE WHEN low_title THEN 1 ELSE 0 END AS s4,
         CASE WHEN wv > 0 THEN round(CASE WHEN figures > 0 THEN fig_area ELSE body_area END, 3) ELSE 0 END AS s5,
         CASE WHEN bodies <= 1 THEN 0 ELSE abs(bodies - CASE WHEN wt <= 4 THEN 1 ELSE least(bodies, 2) END) END AS s6,
         round(text_area, 3) AS s7
  FROM needs n JOIN feat f USING (template_id)),
ranked AS (
  SELECT *, layout_id = layout_hint AS hinted, exact AS ex, prio IS NOT NULL AND NOT low_title AS vi,
    row_number() OVER (PARTITION BY slide_uid, exact ORDER BY s1 DESC, s2 DESC, s3, s4, s5 DESC, s6, s7 DESC, text_units DESC, layout_no) AS r_exact,
    row_number() OVER (PARTITION BY slide_uid, prio IS NOT NULL AND NOT low_title
      ORDER BY s1 DESC, s2 DESC, s3, s4, s5 DESC, s6, s7 DESC, text_units DESC, prio, layout_no) AS r_viable,
    row_number() OVER (PARTITION BY slide_uid, prio IS NOT NULL ORDER BY prio, s1 DESC, s2 DESC, s3, s4, s5 DESC, s6, s7 DESC,
      text_units DESC, layout_no) AS r_fall,
    row_number() OVER (PARTITION BY slide_uid ORDER BY text_units DESC, layout_no) AS r_any FROM cand),
picks AS (
  SELECT slide_uid, min(layout_id) FILTER (hinted) AS hint, min(layout_id) FILTER (ex AND r_exact = 1) AS be,
         bool_or(low_title) FILTER (ex AND r_exact = 1) AS be_low, min(layout_id) FILTER (vi AND r_viable = 1) AS vb,
         min(layout_id) FILTER (prio IS NOT NULL AND r_fall = 1) AS fbk, min(layout_id) FILTER (r_any = 1) AS an
  FROM ranked GROUP BY slide_uid),
chosen AS (
  SELECT slide_uid, CASE WHEN hint IS NOT NULL THEN hint WHEN be IS NOT NULL AND NOT (be_low AND vb IS NOT NULL) THEN be
                         WHEN be IS NOT NULL THEN vb ELSE coalesce(fbk, an) END AS layout_id,
         hint IS NULL AND (be IS NULL OR (be_low AND vb IS NOT NULL)) AS substituted FROM picks),
bound AS (
  SELECT n.*, c.layout_id, c.substituted, CASE WHEN wv > 0 AND figures = 0 AND bodies > 0 THEN body_units * 45 // 100 ELSE body_units END AS text_capacity,
         title_units AS title_capacity, bodies, figures, f.lines
  FROM needs n JOIN chosen c USING (slide_uid) JOIN feat f ON f.layout_id = c.layout_id)"""


def needs(spark, sf):
    t = c.deck_tables(spark, sf)
    u = F.col("slide_uid")
    s = t.slides.withColumn("template_id", (F.col("deck_uid") % 5).cast("int")).withColumn(
        "role", F.when(u % 4 == 0, "cover").when(u % 9 == 0, "equation").otherwise(F.col("role"))).withColumn(
        "layout_hint", F.when(u % 29 == 0, (u % 25).cast("int")))
    return ly.slide_needs(s, t.blocks)


def bound(spark, sf):
    return ly.bind_layouts(needs(spark, sf), layouts(spark, sf), slots(spark, sf))


@query("bind_layouts", b.with_(b.SLIDES, b.BLOCKS, LAYOUTS, NEEDS, body="""
SELECT slide_uid, layout_id, substituted, CAST(text_capacity AS BIGINT) AS text_capacity, title_capacity, bodies AS body_slots,
       figures AS figure_slots, lines AS bullet_lines FROM bound"""))
def bind_layouts(spark, sf):
    return bound(spark, sf).select("slide_uid", "layout_id", "substituted", "text_capacity", "title_capacity", "body_slots",
                                   "figure_slots", "bullet_lines")


@query("missing_roles", b.with_(b.SLIDES, b.BLOCKS, LAYOUTS, NEEDS, body="""
SELECT DISTINCT n.template_id, n.brole AS role, n.deck_uid FROM needs n
WHERE NOT EXISTS (SELECT 1 FROM layouts l WHERE l.template_id = n.template_id AND list_contains(l.roles, n.brole))"""))
def missing_roles(spark, sf):
    return ly.missing_roles(needs(spark, sf), layouts(spark, sf))


@query("supported_roles", b.with_(LAYOUTS, body="""
SELECT DISTINCT template_id, unnest(roles) AS role FROM layouts"""))
def supported_roles(spark, sf):
    return ly.supported_roles(layouts(spark, sf))


@query("layouts_for_role", b.with_(LAYOUTS, body="""
SELECT template_id, layout_id, layout_no, text_units, row_number() OVER (PARTITION BY template_id ORDER BY text_units DESC, layout_no)
  AS rank FROM feat WHERE list_contains(roles, 'text_dense')"""))
def layouts_for_role(spark, sf):
    return ly.layouts_for(layouts(spark, sf), slots(spark, sf), "text_dense")


@query("layout_classes", b.with_(LAYOUTS, body="""
SELECT layout_id, array_to_string(CASE WHEN n % 7 = 1 THEN
    list_concat(['big_figure'], CASE WHEN bodies = 1 AND body_area > 0.18 THEN ['text_figure', 'table'] ELSE [] END,
                CASE WHEN bodies >= 2 THEN ['two_column'] ELSE [] END)
  WHEN bodies >= 3 THEN ['three_column', 'text_dense'] WHEN bodies = 2 THEN ['two_column', 'text_figure', 'text_dense']
  WHEN figures > 0 THEN ['text_figure', 'big_figure', 'table']
  ELSE list_concat(['text_dense', 'agenda', 'summary', 'equation'],
                   CASE WHEN body_area > 0.18 THEN ['text_figure', 'table'] ELSE [] END) END, ',') AS roles FROM feat"""))
def layout_classes(spark, sf):
    f = ly.classify_layout(ly.layout_features(layouts(spark, sf), slots(spark, sf)))
    return f.select("layout_id", F.array_join("roles_found", ",").alias("roles"))


@query("template_report", b.with_(LAYOUTS, body="""
SELECT template_id, count(*) AS layouts_found, count(*) AS layouts_kept, CAST(sum(unmeasured) AS BIGINT) AS unmeasured_slots
FROM feat GROUP BY template_id"""))
def template_report(spark, sf):
    f = ly.layout_features(layouts(spark, sf), slots(spark, sf))
    return ly.ingest_report(f).select("template_id", "layouts_found", "layouts_kept", "unmeasured_slots")


@query("overflow_rate", b.with_(b.SLIDES, b.BLOCKS, LAYOUTS, NEEDS, """
used AS (SELECT slide_uid, sum(units) AS used FROM blocks WHERE channel = 'slide' AND NOT is_visual GROUP BY slide_uid)""", body="""
SELECT deck_uid, count(*) AS bound, count(*) FILTER (text_capacity > 0 AND coalesce(used, 0) > text_capacity) AS over,
       round(count(*) FILTER (text_capacity > 0 AND coalesce(used, 0) > text_capacity) / count(*), 4)::DOUBLE AS rate
FROM bound LEFT JOIN used USING (slide_uid) GROUP BY deck_uid"""))
def overflow_rate(spark, sf):
    return ly.overflow_rate(bound(spark, sf), c.num_blocks(spark, sf))


@query("title_overflows", b.with_(b.SLIDES, b.BLOCKS, LAYOUTS, NEEDS, body="""
SELECT slide_uid, CAST(slide_uid % 60 AS BIGINT) AS title_units, title_capacity FROM bound WHERE slide_uid % 60 > title_capacity"""))
def title_overflows(spark, sf):
    s = bound(spark, sf).withColumn("title_units", F.col("slide_uid") % 60)
    return ly.title_overflows(s).select("slide_uid", "title_units", "title_capacity")


@query("visual_slots", b.with_(b.SLIDES, b.BLOCKS, LAYOUTS, NEEDS, """
vis AS (SELECT slide_uid, block_uid, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no) AS visual_no
        FROM blocks WHERE is_visual AND channel = 'slide'),
fs AS (SELECT layout_id, slot_id, row_number() OVER (PARTITION BY layout_id ORDER BY w * h DESC) AS k FROM slots WHERE kind = 'figure'),
bs AS (SELECT layout_id, slot_id, row_number() OVER (PARTITION BY layout_id ORDER BY w * h DESC) AS k FROM slots WHERE kind = 'body')""",
                               body="""
SELECT v.slide_uid, v.block_uid, v.visual_no, CASE WHEN visual_no <= figures THEN fs.slot_id
   WHEN visual_no - figures <= bodies - CASE WHEN wt > 0 THEN 1 ELSE 0 END THEN bs.slot_id END AS slot_id
FROM vis v JOIN bound n USING (slide_uid) LEFT JOIN fs ON fs.layout_id = n.layout_id AND fs.k = v.visual_no
LEFT JOIN bs ON bs.layout_id = n.layout_id AND bs.k = v.visual_no - n.figures"""))
def visual_slots(spark, sf):
    from briefloom import scale

    blocks = c.num_blocks(spark, sf).filter("is_visual AND channel = 'slide'").select("slide_uid", "block_uid", *c.POSITION)
    vis = scale.running(blocks, ["slide_uid"], {"__c1": F.col("line_no"), "__c2": F.floor(F.col("part_key") / 4096)},
                        list(c.POSITION), number="visual_no")
    return ly.place_visuals(bound(spark, sf), vis.select("slide_uid", "block_uid", "visual_no"), slots(spark, sf))


@query("columns_filled", b.with_(b.BLOCKS, """
tx AS (SELECT slide_uid, block_no, units AS w, count(*) OVER (PARTITION BY slide_uid) AS n,
              sum(units) OVER (PARTITION BY slide_uid) AS total FROM blocks),
walk AS (
  SELECT slide_uid, 0::BIGINT AS block_no, 0 AS col, 0::BIGINT AS load, 0 AS k FROM (SELECT DISTINCT slide_uid FROM tx)
  UNION ALL
  SELECT slide_uid, block_no, ncol, CASE WHEN ncol = col THEN load ELSE 0 END + w, k + 1 FROM (
    SELECT t.slide_uid, t.block_no, t.w, x.col, x.load, x.k,
           CASE WHEN t.n > 4 AND x.col < 2 AND x.load > 0 AND x.load * 160 >= [80, 50, 30][x.col + 1] * t.total THEN x.col + 1 ELSE x.col END AS ncol
    FROM walk x JOIN tx t ON t.slide_uid = x.slide_uid AND t.block_no = x.block_no + 1))""", recursive=True, body="""
SELECT slide_uid, block_no, col AS "column" FROM walk WHERE k > 0"""))
def columns_filled(spark, sf):
    blocks = c.numbered_blocks(c.num_blocks(spark, sf).select("slide_uid", "block_uid", *c.POSITION))
    b2 = blocks.select("slide_uid", "block_no", F.col("units").alias("weight"))
    want = c.num_slides(spark, sf).select("slide_uid", F.array(F.lit(80), F.lit(50), F.lit(30)).alias("caps"))
    return ly.distribute_columns(b2, want).select("slide_uid", "block_no", "column")


# -------------------------------------------------------------------- pointing

ANCHORS = """placed AS (SELECT *, row_number() OVER (PARTITION BY deck_uid ORDER BY slide_no) AS slide_index FROM slides),
anchors AS (
  SELECT deck_uid, slide_index, block_uid AS uid, CASE WHEN type = 'figure' THEN 'figure' ELSE 'block' END AS kind, 0.05::DOUBLE AS x,
         ((1000 * n + 8500 * (block_no - 1)) // n) / 10000.0::DOUBLE AS y, 0.9::DOUBLE AS w, (8000 // n) / 10000.0::DOUBLE AS h, 0.85::DOUBLE AS confidence
  FROM blocks JOIN placed USING (slide_uid) JOIN (SELECT slide_uid, count(*) AS n FROM blocks GROUP BY slide_uid) USING (slide_uid)),
clicks AS (
  SELECT event_id AS gesture_id, user_id AS deck_uid, 1 + event_id % 5 AS slide_index, (event_id % 97) / 97.0::DOUBLE AS px,
         CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0::DOUBLE AS py FROM events)"""

HITS = """pairs AS (
  SELECT c.gesture_id, a.*, px >= x AND px <= x + w AND py >= y AND py <= y + h AS inside,
         sqrt(pow(greatest(x - px, 0, px - (x + w)), 2) + pow(greatest(y - py, 0, py - (y + h)), 2)) AS d
  FROM clicks c JOIN anchors a ON a.deck_uid = c.deck_uid AND a.slide_index = c.slide_index),
hits AS (
  SELECT gesture_id, uid, round((0.45 * CASE WHEN inside THEN 1.0 ELSE 1.0 - d / 0.02 END + 0.35 * (1.0 - least(1.0, w * h))
         + 0.2 * CASE kind WHEN 'block' THEN 1.0 ELSE 0.9 END) * confidence, 4)::DOUBLE AS score
  FROM pairs WHERE inside OR d <= 0.02),
rk AS (SELECT *, row_number() OVER (PARTITION BY gesture_id ORDER BY score DESC, uid) AS rank FROM hits)"""


@query("hit_test", b.with_(b.SLIDES, b.BLOCKS, ANCHORS, HITS, body="SELECT gesture_id, uid, score FROM hits"))
def hit_test(spark, sf):
    cl = c.clicks(spark, sf)
    return cl.join(pt.hit_test(cl, c.anchors(spark, sf)), pt.POINT).select("gesture_id", "uid", "score")


@query("top_hits", b.with_(b.SLIDES, b.BLOCKS, ANCHORS, HITS, body="SELECT gesture_id, uid, score, rank FROM rk WHERE rank <= 4"))
def top_hits(spark, sf):
    cl = c.clicks(spark, sf)
    top = pt.top_hits(pt.hit_test(cl, c.anchors(spark, sf)))
    return cl.join(top, pt.POINT).select("gesture_id", "uid", "score", F.col("rank").cast("long").alias("rank"))


@query("ambiguous_hits", b.with_(b.SLIDES, b.BLOCKS, ANCHORS, HITS, """
two AS (SELECT gesture_id, max(uid) FILTER (rank = 1) AS uid, max(score) FILTER (rank = 1) AS s1,
               max(score) FILTER (rank = 2) AS s2 FROM rk GROUP BY gesture_id)""", body="""
SELECT c.gesture_id, t.uid, t.s1 AS score, CASE WHEN t.uid IS NOT NULL THEN coalesce(round(s1 - s2, 4) < 0.15, false) END AS ambiguous
FROM clicks c LEFT JOIN two t USING (gesture_id)"""))
def ambiguous_hits(spark, sf):
    return pt.point_results(c.clicks(spark, sf), c.anchors(spark, sf)).select("gesture_id", "uid", "score", "ambiguous")


RECTS = """rects AS (
  SELECT event_id AS gesture_id, user_id AS deck_uid, 1 + event_id % 5 AS slide_index, (event_id % 7) / 10.0::DOUBLE AS x,
         (event_id % 11) / 20.0::DOUBLE AS y, 0.3::DOUBLE + (event_id % 13) / 20.0::DOUBLE AS w, 0.02::DOUBLE + (event_id % 17) / 40.0::DOUBLE AS h
  FROM events WHERE event_type = 'click')"""
LASSO = """cov AS (
  SELECT r.gesture_id, a.uid, confidence,
         greatest(0, least(a.x + a.w, r.x + r.w) - greatest(a.x, r.x)) * greatest(0, least(a.y + a.h, r.y + r.h) - greatest(a.y, r.y))
           / (a.w * a.h) AS coverage
  FROM rects r JOIN anchors a ON a.deck_uid = r.deck_uid AND a.slide_index = r.slide_index)"""


def rects(spark, sf):
    e = F.col("event_id")
    return c.read(spark, sf, "events").filter("event_type = 'click'").select(
        e.alias("gesture_id"), F.col("user_id").alias("deck_uid"), (1 + e % 5).alias("slide_index"), (e % 7 / F.lit(10.0)).alias("x"),
        (e % 11 / F.lit(20.0)).alias("y"), (F.lit(0.3) + e % 13 / F.lit(20.0)).alias("w"), (F.lit(0.02) + e % 17 / F.lit(40.0)).alias("h"))


@query("lasso", b.with_(b.SLIDES, b.BLOCKS, ANCHORS, RECTS, LASSO, body="""
SELECT gesture_id, uid, round(coverage * confidence, 4)::DOUBLE AS score FROM cov WHERE coverage >= 0.45"""))
def lasso(spark, sf):
    return pt.lasso(rects(spark, sf), c.anchors(spark, sf)).select("gesture_id", "uid", "score")


@query("selection_resolved", b.with_(b.SLIDES, b.BLOCKS, ANCHORS, HITS, RECTS, LASSO, body="""
SELECT gesture_id, uid, 'lasso' AS gesture, round(coverage * confidence, 4)::DOUBLE AS score FROM cov WHERE coverage >= 0.45
UNION ALL SELECT gesture_id, uid, 'point', score FROM rk JOIN events ON event_id = gesture_id
  WHERE rank = 1 AND event_type IN ('view', 'purchase')
UNION ALL SELECT event_id, NULL, 'error', NULL FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')"""))
def selection_resolved(spark, sf):
    e = c.read(spark, sf, "events").select(F.col("event_id").alias("gesture_id"), "event_type")
    boxes = rects(spark, sf).select("gesture_id", "x", "y", "w", "h")
    g = c.clicks(spark, sf).join(e, "gesture_id").join(boxes, "gesture_id", "left")
    shown = F.col("event_type").isin("click", "view", "purchase")
    g = g.withColumn("px", F.when(shown, F.col("px"))).withColumn("py", F.when(shown, F.col("py")))
    return pt.resolve_selection(g, c.anchors(spark, sf)).select("gesture_id", "uid", "gesture", "score")


# ---------------------------------------------------------------- page geometry

WORDS_SQL = """pw AS (
  SELECT doc_id AS file, page, 600.0::DOUBLE AS page_w, 500.0::DOUBLE AS page_h, x + least(len(text) * 4, 260) AS x_max,
         (y - 480 * (page - 1)) * (1 + doc_id % 3 * 0.01::DOUBLE) AS y_max FROM dl)"""


def page_words(spark, sf):
    return doc_lines(spark, sf).select(
        F.col("doc_id").alias("file"), "page", F.lit(600.0).alias("page_w"), F.lit(500.0).alias("page_h"),
        (F.col("x") + F.least(F.length("text") * 4, F.lit(260))).alias("x_max"),
        ((F.col("y") - 480 * (F.col("page") - 1)) * (1 + F.col("doc_id") % 3 * F.lit(0.01))).alias("y_max"))


@query("page_extent", b.with_(DOCLINES, WORDS_SQL, body="""
SELECT file, page, max(page_w) AS page_w, max(page_h) AS page_h, count(*) AS words, max(y_max)::DOUBLE AS lowest, max(x_max)::DOUBLE AS rightmost,
       max(y_max) / max(page_h) > 0.955 OR max(x_max) / max(page_w) > 0.97 AS overflows FROM pw GROUP BY file, page"""))
def page_extent(spark, sf):
    return pg.page_extent(page_words(spark, sf))


@query("page_overflow_rate", b.with_(DOCLINES, WORDS_SQL, """
e AS (SELECT file, page, max(y_max) / max(page_h) > 0.955 OR max(x_max) / max(page_w) > 0.97 AS o FROM pw GROUP BY file, page)""", body="""
SELECT file, count(*) AS pages, count(*) FILTER (o) AS over, round(count(*) FILTER (o) / count(*), 4)::DOUBLE AS rate FROM e GROUP BY file"""))
def page_overflow_rate(spark, sf):
    return pg.page_overflow_rate(pg.page_extent(page_words(spark, sf)))


@query("bbox_words", b.with_(b.LINES, """
t AS (SELECT doc_id AS file, slide_no, 'x' AS q FROM lines)""", body="""
SELECT file, slide_no AS line_no, 1 + (slide_no - 1) // 5 AS page, CAST(600 + (slide_no - 1) // 5 AS DOUBLE) AS page_w,
       400.5::DOUBLE AS page_h, CAST(slide_no AS DOUBLE) AS x_min, 2.25::DOUBLE AS y_min, CAST(slide_no + 10 AS DOUBLE) AS x_max, 9.0::DOUBLE AS y_max
FROM t WHERE slide_no % 5 <> 1"""))
def bbox_words(spark, sf):
    n = F.col("slide_no")
    tag = F.when(n % 5 == 1, F.concat(F.lit('<page width="'), 600 + F.floor((n - 1) / 5), F.lit('.0" height="400.5">'))).otherwise(
        F.concat(F.lit('  <word xMin="'), n, F.lit('.0" yMin="2.25" xMax="'), n + 10, F.lit('.0" yMax="9.0">'), F.lit("w</word>")))
    t = c.lines(spark, sf).select(F.col("doc_id").alias("file"), n.alias("line_no"), tag.alias("text"))
    return pg.bbox_words(t)


@query("build_logs", b.with_(b.LINES, body="""
SELECT doc_id AS file, 'line 12: Undefined control sequence' AS message, min(slide_no) AS line_no, 'error' AS kind FROM lines
  WHERE slide_no % 7 = 1 GROUP BY doc_id
UNION ALL SELECT doc_id, 'Emergency ' || slide_no % 2, min(slide_no), 'error' FROM lines WHERE slide_no % 7 = 2 GROUP BY doc_id, slide_no % 2
UNION ALL SELECT doc_id, 'Overfull \\hbox (3.5pt too wide)', slide_no, 'box' FROM lines WHERE slide_no % 7 = 3"""))
def build_logs(spark, sf):
    n = F.col("slide_no")
    text = (F.when(n % 7 == 1, F.lit("./t.tex:12: Undefined control sequence")).when(n % 7 == 2, F.concat(F.lit("! Emergency "), n % 2))
            .when(n % 7 == 3, F.lit("Overfull \\hbox (3.5pt too wide) in paragraph")).when(n % 7 == 4, F.lit("! Rerun to get it right"))
            .otherwise(F.concat(F.lit("("), "line")))
    return pg.scan_build_logs(c.lines(spark, sf).select(F.col("doc_id").alias("file"), n.alias("line_no"), text.alias("text")))


ORDERED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY deck_uid ORDER BY is_backup, section_no, slide_no) AS page_no FROM slides)"""


@query("visible_order", b.with_(b.SLIDES, ORDERED, body="SELECT deck_uid, slide_uid, page_no FROM ordered"))
def visible_order(spark, sf):
    return pg.visible_order(c.num_slides(spark, sf)).select("deck_uid", "slide_uid", "page_no")


@query("repair_victims", b.with_(b.SLIDES, b.BLOCKS, ORDERED, """
over AS (SELECT DISTINCT user_id AS deck_uid, 1 + event_id % 6 AS page_no FROM events)""", body="""
SELECT deck_uid, page_no, slide_uid, arg_min(block_uid, importance_milli * 100000 + block_no) AS block_uid, count(*) AS movable
FROM over JOIN ordered USING (deck_uid, page_no) JOIN blocks USING (slide_uid)
WHERE channel = 'slide' AND NOT is_visual AND NOT pinned GROUP BY ALL"""))
def repair_victims(spark, sf):
    over = c.read(spark, sf, "events").select(F.col("user_id").alias("deck_uid"), (1 + F.col("event_id") % 6).alias("page_no")).distinct()
    found = pg.page_to_slide(over, pg.visible_order(c.num_slides(spark, sf)))
    return found.join(pg.least_important(c.num_blocks(spark, sf), F.struct(*c.POSITION)), "slide_uid").select(
        "deck_uid", "page_no", "slide_uid", "block_uid", "movable")


@query("anchor_boxes", b.with_(b.BLOCKS, """
ln AS (SELECT *, (1 + units // 10) * (14 + slide_uid % 5) * 1.22::DOUBLE AS hh FROM blocks WHERE channel = 'slide'),
st AS (SELECT *, coalesce(sum(CAST(round(hh * 10000) AS BIGINT)) OVER (PARTITION BY slide_uid ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10000 AS top,
              sum(CAST(round(hh * 10000) AS BIGINT)) OVER (PARTITION BY slide_uid) / 10000 AS al FROM ln),
bx AS (SELECT slide_uid, block_no, least(1, greatest(0, (100 + CASE slide_uid % 3 WHEN 0 THEN greatest(0, 300 - al) / 2 WHEN 1 THEN greatest(0, 300 - al) ELSE 0 END + top) / 540)) AS y,
              CAST(round(hh * 10000) AS BIGINT) / 10000 / 540 AS h FROM st)""", body="""
SELECT slide_uid, block_no, round(y, 5)::DOUBLE AS y, round(least(1 - y, h), 5)::DOUBLE AS h FROM bx WHERE least(1 - y, h) > 0"""))
def anchor_boxes(spark, sf):
    blocks = c.numbered_blocks(c.num_blocks(spark, sf).select("slide_uid", "block_uid", "channel", *c.POSITION)).filter("channel = 'slide'")
    u = F.col("slide_uid")
    a = blocks.select("slide_uid", "block_no", (1 + F.floor(F.col("units") / 10)).alias("lines"), (14 + u % 5).alias("font_size"),
                      F.lit(40.0).alias("slot_x"), F.lit(100.0).alias("slot_y"), F.lit(600.0).alias("slot_w"), F.lit(300.0).alias("slot_h"),
                      F.when(u % 3 == 0, "middle").when(u % 3 == 1, "bottom").otherwise("top").alias("anchor"),
                      F.lit(720.0).alias("page_w"), F.lit(540.0).alias("page_h"))
    return pg.anchor_layout(a).select("slide_uid", "block_no", F.round("y", 5).alias("y"), F.round("h", 5).alias("h"))


@query("box_math", b.with_(b.SLIDES, b.BLOCKS, ANCHORS, body="""
SELECT uid, round(w * h, 6) AS area, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy, round(w / h, 6) AS aspect,
       CAST(round_even(w * 12700, 0) AS BIGINT) AS emu, CASE WHEN kind = 'figure' THEN '16:9' ELSE '1.250:1' END AS label,
       CASE WHEN kind = 'figure' THEN 800 ELSE 600 END AS pic_w FROM anchors"""))
def box_math(spark, sf):
    box = sh.Box.of()
    fig = F.col("kind") == "figure"
    w = F.when(fig, 1600.0).otherwise(1250.0)
    h = F.when(fig, 900.0).otherwise(1000.0)
    pic = sh.fit_picture(F.lit(800), F.when(fig, 450).otherwise(480), w / h)
    return c.anchors(spark, sf).select(
        "uid", F.round(box.area, 6).alias("area"), F.round(box.cx, 6).alias("cx"), F.round(box.cy, 6).alias("cy"),
        F.round(box.aspect, 6).alias("aspect"), sh.pt_to_emu(box.w).alias("emu"), sh.aspect_label(w, h).alias("label"),
        pic["w"].cast("int").alias("pic_w"))


def _sql_class(test) -> str:
    """A class of characters as SQL's regular expressions take it."""
    return "[" + ms.char_class(test) + "]"


def _em(x: str) -> str:
    """SQL for the width of ``x`` in millionths of an em: by classes, each character on its own."""
    n = lambda rule: f"len(regexp_extract_all({x}, '{rule}'))"
    wide, digits = _sql_class(ms.is_wide), _sql_class(lambda ch: ch.isdigit() and not ms.is_wide(ch))
    return f"(len({x}) * 520000 + {n(wide)} * 480000 - {n(' ')} * 260000 + {n(digits)} * 40000)"


_BLANK = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}"
_WORDS = f"regexp_extract_all(t, '(?s)[A-Za-z0-9][A-Za-z0-9''./-]*|{_BLANK}]+|.')"


def _fold(words: str, limit: str) -> str:
    """SQL that breaks lines: a fold over ``words`` (w, n, kind, each: widths of the characters), giving the open line at the end.

    Written from the rules: a line ends before a word that does not fit, an overhanging blank vanishes, an overhanging
    closing mark stays, opening marks at the end go down, a word wider than a line is filled in character by character.
    """
    opened = "list_sum(s.opens)"
    broken = f"""list_reduce(e, lambda a, w: CASE WHEN a.n > 0 AND a.used + w > {limit}
        THEN {{'lines': a.lines + 1, 'used': w, 'real_': w, 'n': 1, 'opens': a.opens, 'widest': greatest(a.widest, a.real_)}}
        ELSE {{'lines': a.lines, 'used': a.used + w, 'real_': a.real_ + w, 'n': a.n + 1, 'opens': a.opens, 'widest': a.widest}} END, f)"""

    def line(lines: str, used: str, real: str, n: str, opens: str, widest: str) -> str:
        return f"{{'lines': CAST({lines} AS BIGINT), 'used': CAST({used} AS BIGINT), 'real_': CAST({real} AS BIGINT), 'n': CAST({n} AS BIGINT), 'opens': {opens}, 'widest': CAST({widest} AS BIGINT)}}"

    none = "CAST([] AS BIGINT[])"
    fills = lambda each, start, opens: broken.replace("list_reduce(e,", f"list_reduce({each},").replace(", f)", f", {line(*start[:4], opens, start[4])})")
    sum_opens = f"coalesce({opened}, 0)"
    end = "CASE WHEN x.kind = 'opening' THEN [x.w] ELSE " + none + " END"
    on = "CASE WHEN x.kind = 'opening' THEN list_concat(s.opens, [x.w]) ELSE " + none + " END"
    return f"""list_reduce({words}, lambda s, x: CASE
      WHEN s.n = 0 AND x.kind = 'blank' THEN s
      WHEN s.n = 0 AND x.w > {limit} THEN {fills('x.each', ('s.lines', 's.used', 's.real_', 's.n', 's.widest'), end)}
      WHEN s.n = 0 OR s.used + x.w <= {limit} THEN {line('s.lines', 's.used + x.w', 's.real_ + x.w', 's.n + x.n', on, 's.widest')}
      WHEN x.kind = 'blank' THEN {line('s.lines + 1', '0', '0', '0', none, 'greatest(s.widest, s.real_)')}
      WHEN x.kind = 'closing' THEN {line('s.lines + 1', '0', '0', '0', none, 'greatest(s.widest, s.real_ + x.w)')}
      WHEN x.w > {limit} THEN {fills('list_concat(s.opens, x.each)', ('s.lines + 1', '0', '0', '0', f'greatest(s.widest, s.real_ - {sum_opens})'), end)}
      ELSE {line('s.lines + 1', 'x.w', f'{sum_opens} + x.w', 'len(s.opens) + x.n', on, f'greatest(s.widest, s.real_ - {sum_opens})')} END,
      {line('0', '0', '0', '0', none, '0')})"""


_KIND = """CASE WHEN regexp_matches(w, '^[A-Za-z0-9]') THEN 'plain' WHEN regexp_matches(w, '^{blank}\\x{{3000}}]') THEN 'blank'
  WHEN contains('{closing}', w) THEN 'closing' WHEN contains('{opening}', w) THEN 'opening' ELSE 'plain' END""".format(
    blank=_BLANK, closing=ms.CLOSING, opening=ms.OPENING)
FITTED = f"""
cut AS (SELECT DISTINCT line AS t, unnest(list_distinct({_WORDS.replace('(t,', '(line,')})) AS w FROM (SELECT DISTINCT line FROM lines)),
kinds AS (SELECT w, struct_pack(kind := {_KIND}, w := CAST({_em('w')} AS BIGINT), n := len(w),
                 "each" := list_transform(string_split(w, ''), lambda c: CAST({_em('c')} AS BIGINT))) AS x FROM (SELECT DISTINCT w FROM cut)),
placed AS (SELECT t, unnest({_WORDS}) AS w, unnest(range(len({_WORDS}))) AS k FROM (SELECT DISTINCT line AS t FROM lines)),
worded AS (SELECT t, list(x ORDER BY k) AS words FROM placed JOIN kinds USING (w) GROUP BY t),
sized AS (SELECT t, words, unnest([12, 14, 16, 18]) AS size FROM worded),
broken AS (SELECT t, size, {_fold('words', "CAST(floor(round(500 / size * 1000000, 3)) AS BIGINT)")} AS s FROM sized),
counted AS (SELECT t, size, greatest(1, s.lines + CASE WHEN s.n > 0 THEN 1 ELSE 0 END) AS lines, greatest(s.widest, s.real_) AS widest,
                   CASE WHEN regexp_matches(t, '{_sql_class(ms.is_wide)}') THEN 1.42::DOUBLE ELSE 1.2::DOUBLE END AS spacing FROM broken),
fitted AS (SELECT t, max(CASE WHEN size = 18 THEN lines END) AS lines, round(max(CASE WHEN size = 18 THEN lines * 18 * spacing / 120 END), 4) AS ratio,
                  round(max(CASE WHEN size = 18 THEN widest / 1000000 * 18 END), 3) AS widest,
                  coalesce(max(CASE WHEN lines * size * spacing / 120 <= 1 THEN size END), 12) AS size FROM counted GROUP BY t)"""


@query("string_width", b.with_(b.LINES, body=f"SELECT doc_id, slide_no, round({_em('line')} / 1000000.0 * 18, 3)::DOUBLE AS width FROM lines"))
def string_width(spark, sf):
    return c.lines(spark, sf).select("doc_id", "slide_no", F.round(ms.string_width("line", F.lit(18.0)), 3).alias("width"))


def fonts(spark, sf):
    """Advances of two fonts for the characters the documents use; each lacks some, and the second gives a few no width."""
    chars = c.documents(spark, sf).select(F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("ch")).distinct()
    code = F.ascii("ch")
    one = chars.filter(code % 7 != 0).select(F.lit("serif").alias("font"), "ch", (F.lit(0.2) + code % 64 / 100).alias("em"))
    two = chars.filter(code % 5 != 0).select(F.lit("mono").alias("font"), "ch", F.when(code % 11 == 0, 0.0).otherwise(0.6).alias("em"))
    return one.unionByName(two)


@query("font_widths", b.with_(b.LINES, f"""
rows_ AS (SELECT doc_id, slide_no, unnest(string_split(line, '')) AS ch FROM lines),
per AS (SELECT doc_id, slide_no, ch, count(*) AS n FROM rows_ GROUP BY ALL),
known AS (SELECT ch, CAST({_em('ch')} AS BIGINT) AS em, unicode(ch) AS code FROM (SELECT DISTINCT ch FROM per WHERE ch <> '')),
ems AS (SELECT ch, 'serif' AS font, CASE WHEN code % 7 <> 0 THEN CAST(round((0.2 + code % 64 / 100) * 1000000) AS BIGINT) ELSE em END AS em FROM known
        UNION ALL SELECT ch, 'mono', CASE WHEN code % 5 <> 0 AND code % 11 <> 0 THEN 600000 ELSE em END FROM known),
sums AS (SELECT doc_id, slide_no, font, sum(n * em) AS em FROM per JOIN ems USING (ch) GROUP BY ALL)""", body="""
SELECT doc_id, slide_no, f.font, CAST(coalesce(em, 0) / 1000000 AS DOUBLE) AS em
FROM lines CROSS JOIN (VALUES ('serif'), ('mono')) f(font) LEFT JOIN sums USING (doc_id, slide_no, font)"""))
def font_widths(spark, sf):
    lines = c.lines(spark, sf).select("doc_id", "slide_no", "line")
    return ms.measured_widths(lines, ["doc_id", "slide_no"], "line", fonts(spark, sf))


@query("fit_blocks", b.with_(b.LINES, FITTED, body="""
SELECT doc_id, slide_no, CAST(coalesce(f.lines, 1) AS INTEGER) AS lines, coalesce(ratio, 0.18) AS ratio, coalesce(widest, 0.0) AS widest,
       CAST(coalesce(f.size, 18) AS INTEGER) AS size FROM lines LEFT JOIN fitted f ON f.t = line"""))
def fit_blocks(spark, sf):
    """Wrapped line count, overflow, widest line and largest fitting size of every line in a fixed box."""
    sizes = F.array(*[F.lit(z) for z in (18, 16, 14, 12)])
    d = c.lines(spark, sf).select("doc_id", "slide_no", ms.line_spacing("line").alias("spacing"), ms.wrap_sizes("line", F.lit(500.0), sizes).alias("all"))
    ratio = lambda x: ms.overflow_ratio(x["wrapped"]["lines"], x["size"], F.col("spacing"), F.lit(120.0))
    first = F.col("all")[0]
    return d.select("doc_id", "slide_no", first["wrapped"]["lines"].alias("lines"), F.round(ratio(first), 4).alias("ratio"),
                    F.round(first["wrapped"]["widest"], 3).alias("widest"), ms.largest_font_fits(
                        F.transform("all", lambda x: F.struct(x["size"].alias("size"), ratio(x).alias("ratio"))), F.lit(18), F.lit(12)).alias("size"))


@query("slot_capacity", b.with_(f"""
boxes AS (SELECT p_partkey, 200.0::DOUBLE + p_partkey % 40 * 10 AS w, 60.0::DOUBLE + p_partkey % 17 * 15 AS h, 14.0::DOUBLE + p_partkey % 10 AS size,
                 CASE WHEN p_partkey % 2 = 0 THEN 'zh' ELSE 'en' END AS lang FROM part),
held AS (SELECT *, CAST(floor(h / (size * CASE WHEN lang = 'zh' THEN 1.42::DOUBLE ELSE 1.2::DOUBLE END)) AS INTEGER) AS lines,
                CAST(floor(round(w / size * 1000000, 3)) AS BIGINT) AS room FROM boxes),
kinds AS (SELECT DISTINCT w, size, lang, lines, room FROM held),
guessed AS (SELECT *, CAST(floor(lines * (w / (CASE WHEN lang = 'zh' THEN 1.0::DOUBLE ELSE {sum(260000 if x == ' ' else 520000 for x in ms.MEAN_SAMPLES['en'])}.0::DOUBLE / {1000000 * len(ms.MEAN_SAMPLES['en'])} END * size)
                   / CASE WHEN lang = 'zh' THEN 1.0::DOUBLE ELSE 6.1::DOUBLE END)) AS INTEGER) AS most FROM kinds),
words AS (SELECT list_transform(string_split('{ms.FILLER_EN}', ' '), lambda c: len(c) * 520000) AS ws),
lined AS (
  -- Line by line: the number of words up to the end of each.
  SELECT g.*, 0 AS line, 0 AS done FROM guessed g
  UNION ALL
  SELECT w, size, lang, lines, room, most, line + 1,
         done + CASE WHEN lang = 'zh' THEN greatest(1, room // 1000000)
                     ELSE greatest(1, (SELECT count(*) FROM (SELECT sum(ws[(done + i) % len(ws) + 1] + CASE WHEN i > 0 THEN 260000 ELSE 0 END) OVER (ORDER BY i) AS upto
                                                             FROM words, range(0, 200) r(i)) WHERE upto <= room)) END
  FROM lined WHERE line < lines),
best AS (SELECT w, size, lang, lines, most, max(done) AS done FROM lined GROUP BY ALL)""".strip(), body="""
SELECT p_partkey, CAST(CASE WHEN h.lines <= 0 OR most <= 0 THEN 0 ELSE least(most, done) END AS INTEGER) AS units, h.lines
FROM held h JOIN best USING (w, size, lang, lines)""").replace("WITH ", "WITH RECURSIVE ", 1))
def slot_capacity(spark, sf):
    """Measured capacity of every block's slot, from its page share."""
    n = F.col("p_partkey")
    return c.spread(c.read(spark, sf, "part").select("p_partkey")).select("p_partkey", ms.capacity_units(
        200.0 + n % 40 * 10, 60.0 + n % 17 * 15, 14.0 + n % 10, F.when(n % 2 == 0, "zh").otherwise("en")).alias("units"),
        ms.lines_available(60.0 + n % 17 * 15, 14.0 + n % 10, F.when(n % 2 == 0, 1.42).otherwise(1.2)).alias("lines"))


@query("overflow_repair", b.with_(b.SLIDES, b.BLOCKS, """
tot AS (SELECT slide_uid, sum(units) AS used FROM blocks WHERE channel = 'slide' AND NOT is_visual GROUP BY slide_uid),
mv AS (SELECT *, row_number() OVER (PARTITION BY slide_uid ORDER BY importance_milli, block_no) AS k FROM blocks
       WHERE channel = 'slide' AND NOT is_visual AND NOT pinned),
run AS (SELECT mv.*, used - coalesce(sum(units) OVER (PARTITION BY slide_uid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
        FROM mv JOIN tot USING (slide_uid))""", body="""
SELECT slide_uid, block_uid, CAST(k AS INTEGER) AS round FROM run WHERE k <= 3 AND left_ > 60"""))
def overflow_repair(spark, sf):
    from briefloom.plans import repair

    t = c.deck_tables(spark, sf)
    _, moves = repair.overflow_repair(t.slides, t.blocks, F.struct(*c.POSITION), repair.over_by_units(F.lit(60)))
    return moves.select("slide_uid", "block_uid", "round")


@query("render_summary", b.with_(b.SLIDES, b.BLOCKS, """
m AS (SELECT deck_uid, slide_uid, 14 + units % 5 AS size, units / 40.0 AS ratio FROM blocks JOIN slides USING (slide_uid))""", body="""
SELECT deck_uid, count(DISTINCT slide_uid) AS slides, count(DISTINCT CASE WHEN ratio > 1 THEN slide_uid END) AS over,
       count(*) FILTER (size < 18 AND ratio <= 1) AS shrunk FROM m GROUP BY deck_uid"""))
def render_summary(spark, sf):
    t = c.deck_tables(spark, sf)
    m = t.blocks.join(t.slides.select("slide_uid", "deck_uid"), "slide_uid").select(
        "deck_uid", "slide_uid", F.lit(18).alias("nominal"), (14 + F.col("units") % 5).alias("size"), (F.col("units") / 40).alias("ratio"))
    return pg.slot_fits(m)


@query("segments_from_lines")
def segments_from_lines(spark, sf):
    """Lines to placed segments in one call; its steps are checked one by one elsewhere."""
    from briefloom.plans import segment

    return segment.segment_documents(doc_lines(spark, sf))
