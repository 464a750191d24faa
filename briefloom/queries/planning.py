"""Planning queries over the text decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import claims as cl
from briefloom.functions import text as tx
from briefloom.operators import planning as pl
from briefloom.plans import plan as pn
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.sources import corpus as c

# Words that occur in the driver's prose stand in for the lexicons.
CLAIMS = ("and ", "und ", "que ")
HEDGES = ("the ", "der ")
RUBRICS = (("innovation", ("er",)), ("budget", ("on", "in")), ("methods", ("ou", "th")), ("motivation", ("a",)))

_T = b.strip("line")
SEGS = f"""raw AS (SELECT doc_id, slide_no AS i, {_T} AS t FROM lines),
segs0 AS (
  SELECT doc_id, i AS seg_no,
         CASE WHEN i % 5 = 1 THEN 'heading' WHEN i % 7 = 4 THEN 'table' WHEN i % 7 = 5 THEN 'caption'
              WHEN i % 9 = 7 THEN 'equation' WHEN i % 3 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind,
         CASE WHEN i % 5 = 1 THEN t WHEN i % 7 = 4 THEN t
              WHEN i % 7 = 5 THEN 'Table ' || i || ': ' || t ELSE t END AS text,
         CASE WHEN i % 5 = 1 THEN 1 + (i // 5 + doc_id) % 3 ELSE 0 END AS level,
         CASE WHEN i % 5 <> 1 AND i % 7 = 4 THEN 'tbl-' || i WHEN i % 5 <> 1 AND i % 7 = 5 THEN 'tbl-' || (i - 1) END
           AS asset_id
  FROM raw),
segs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS ord FROM segs0 WHERE text <> ''),
docs AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN max(text) FILTER (ord = 1) ELSE 'Talk ' || doc_id END AS title
         FROM segs GROUP BY doc_id)"""

GROUPS = """cuts AS (
  SELECT doc_id, CASE WHEN h1 <= 1 AND h2 + f2 > h1 + f1 THEN 2 ELSE 1 END AS cut FROM (
    SELECT doc_id, count(*) FILTER (kind = 'heading' AND level <= 1) AS h1,
           count(*) FILTER (kind = 'heading' AND level <= 2) AS h2,
           count(*) FILTER (ord = 1 AND NOT (kind = 'heading' AND level <= 1)) AS f1,
           count(*) FILTER (ord = 1 AND NOT (kind = 'heading' AND level <= 2)) AS f2 FROM segs GROUP BY doc_id)),
grp AS (
  SELECT *, CAST(sum(CASE WHEN opens OR ord = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) AS no
  FROM (SELECT s.*, kind = 'heading' AND level <= cut AS opens FROM segs s JOIN cuts USING (doc_id))),
gtitles AS (SELECT doc_id, no, max(CASE WHEN opens THEN text END) AS gtitle FROM grp GROUP BY doc_id, no)"""


@query("heading_groups", b.with_(b.LINES, SEGS, GROUPS, body="""
SELECT doc_id, seg_no, no AS group_no, coalesce(gtitle, '') AS title FROM grp JOIN gtitles USING (doc_id, no)"""))
def heading_groups(spark, sf):
    d = pl.heading_groups(c.plan_documents(spark, sf))
    return d.select("doc_id", F.explode(F.zip_with("segs", "groups", lambda s, g: F.struct(
        s["seg_no"].alias("seg_no"), g["no"].alias("group_no"), g["title"].alias("title")))).alias("r")).select(
        "doc_id", "r.*")


FRONT = f"""front AS (
  SELECT g.doc_id, bool_or(ord = 1) AND (NOT bool_or(opens) OR any_value({b.strip('gtitle')} = {b.strip('title')}))
         AND NOT bool_or(kind = 'paragraph' AND len(text) > 80) AS has_front
  FROM grp g JOIN gtitles USING (doc_id, no) JOIN docs USING (doc_id) WHERE no = 1 GROUP BY g.doc_id)"""


@query("front_matter", b.with_(b.LINES, SEGS, GROUPS, FRONT, body="SELECT doc_id, has_front FROM front"))
def front_matter(spark, sf):
    d = pl.front_matter(pl.heading_groups(c.plan_documents(spark, sf)))
    return d.select("doc_id", "has_front")


@query("section_stack", b.with_(b.LINES, SEGS, """
walk AS (
  SELECT doc_id, ord, seg_no, CASE WHEN kind = 'heading' THEN [text] ELSE [] END AS stack, []::VARCHAR[] AS here
  FROM segs WHERE ord = 1
  UNION ALL
  SELECT s.doc_id, s.ord, s.seg_no,
         CASE WHEN kind = 'heading' THEN list_append(w.stack[1:level - 1], s.text) ELSE w.stack END,
         CASE WHEN kind = 'heading' THEN w.stack[1:level - 1] ELSE w.stack END
  FROM walk w JOIN segs s ON s.doc_id = w.doc_id AND s.ord = w.ord + 1)""", recursive=True, body="""
SELECT doc_id, seg_no, array_to_string(here, ' > ') AS path FROM walk"""))
def section_stack(spark, sf):
    d = pl.section_paths(c.plan_documents(spark, sf))
    return d.select("doc_id", F.explode(F.zip_with("segs", "paths", lambda s, p: F.struct(
        s["seg_no"].alias("seg_no"), F.array_join(p, " > ").alias("path")))).alias("r")).select("doc_id", "r.*")


def flat_segments(spark, sf):
    return c.plan_documents(spark, sf).select("doc_id", F.explode("segs").alias("s")).select("doc_id", "s.*")


@query("reference_zone", b.with_(b.LINES, SEGS, """
r AS (SELECT doc_id, seg_no, kind,
             CASE WHEN kind = 'heading' AND seg_no % 15 = 6 THEN 'References' ELSE text END AS text FROM segs),
z AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text = 'References' END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY seg_no) AS zone FROM r)""", body="""
SELECT doc_id, seg_no, coalesce(zone, false) AND kind <> 'heading' AS in_references FROM z"""))
def reference_zone(spark, sf):
    s = flat_segments(spark, sf)
    ref = (F.col("kind") == "heading") & (F.col("seg_no") % 15 == 6)
    s = s.withColumn("text", F.when(ref, "References").otherwise(F.col("text")))
    return pl.reference_zone(s).select("doc_id", "seg_no", "in_references")


@query("float_runs", b.with_(b.LINES, SEGS, """
f AS (SELECT *, asset_id IS NOT NULL AND asset_id IS DISTINCT FROM
        lag(asset_id) OVER (PARTITION BY doc_id ORDER BY seg_no) AS fresh FROM segs)""", body="""
SELECT doc_id, seg_no, CAST(CASE WHEN asset_id IS NOT NULL THEN
  sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY seg_no) END AS BIGINT) AS run_no FROM f"""))
def float_runs(spark, sf):
    return pl.float_runs(flat_segments(spark, sf)).select("doc_id", "seg_no", "run_no")


@query("segment_kinds", b.with_(b.LINES, SEGS, body="""
SELECT kind, count(*) AS n, count(*) FILTER (kind NOT IN ('metadata', 'reference', 'footnote', 'caption')) AS content,
       count(*) FILTER (kind = 'heading') AS headings FROM segs GROUP BY kind"""))
def segment_kinds(spark, sf):
    from briefloom.operators import model as md

    s = flat_segments(spark, sf)
    marked = (md.content_segments(s).select("doc_id", "seg_no", F.lit(1).alias("is_content")))
    heads = md.headings(s).select("doc_id", "seg_no", F.lit(1).alias("is_head"))
    j = s.join(marked, ["doc_id", "seg_no"], "left").join(heads, ["doc_id", "seg_no"], "left")
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("is_content").alias("content"),
                                 F.count("is_head").alias("headings"))


_ANY = lambda x, ws: "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"
RUBRIC_SQL = "CASE " + " ".join(f"WHEN {_ANY('lower({t})', ws)} THEN '{k}'" for k, ws in RUBRICS) + " END"


def score_sql(kind: str, text: str, rubric: str) -> str:
    return f"""greatest(50, least(1000, 450 + CASE {kind} WHEN 'list_item' THEN 120 WHEN 'caption' THEN 50 ELSE 0 END
  + CASE WHEN {_ANY(f'lower({text})', CLAIMS)} THEN 220 ELSE 0 END
  - CASE WHEN {_ANY(f'lower({text})', HEDGES)} THEN 180 ELSE 0 END
  + CASE WHEN regexp_matches({text}, '[0-9]+(?:[.][0-9]+)? *(?:%|个百分点|倍|x|×)|提升|improv|reduc|increas|decreas|outperform')
         THEN 150 WHEN regexp_matches({text}, '[0-9]') THEN 50 ELSE 0 END
  - CASE WHEN len({text}) > 220 THEN 120 WHEN len({text}) < 12 THEN 80 ELSE 0 END
  + CASE WHEN {rubric} IN ('innovation', 'objectives', 'results') THEN 100
         WHEN {rubric} IN ('budget', 'schedule') THEN -50 ELSE 0 END))"""


@query("keyword_class", b.with_(b.LINES, SEGS, body=f"""
SELECT doc_id, seg_no, {RUBRIC_SQL.format(t='text')} AS rubric_key FROM segs WHERE kind = 'heading'"""))
def keyword_class(spark, sf):
    s = flat_segments(spark, sf).filter("kind = 'heading'")
    return s.select("doc_id", "seg_no", cl.classify_by_keywords("text", RUBRICS).alias("rubric_key"))


BLOCKS_SQL = f"""scored AS (
  SELECT *, {score_sql('kind', 'text', 'rubric')} AS base,
         list_filter(string_split(regexp_replace(text, '([.!?。！？；]){b.SPACE}*', '\\1' || chr(1), 'g'), chr(1)),
                     lambda s: {b.strip('s')} <> '') AS ss
  FROM (SELECT g.*, gtitle, {RUBRIC_SQL.format(t="coalesce(gtitle, '')")} AS rubric
        FROM grp g JOIN gtitles USING (doc_id, no))),
blk AS (
  SELECT doc_id, ord, seg_no, kind, asset_id, no, rubric,
         CASE WHEN asset_id IS NOT NULL THEN CASE WHEN kind = 'table' OR asset_id LIKE 'tbl%' THEN 'table' ELSE 'figure' END
              WHEN kind IN ('equation', 'code', 'quote') THEN kind
              WHEN kind IN ('paragraph', 'list_item', 'caption') THEN 'bullet' END AS type,
         CASE WHEN asset_id IS NOT NULL THEN CASE WHEN kind = 'caption' THEN text ELSE '' END
              WHEN kind IN ('equation', 'code', 'quote') THEN text
              WHEN kind IN ('paragraph', 'list_item', 'caption') THEN
                CASE WHEN len(ss) <= 1 OR len(text) <= 30 THEN text ELSE {b.strip('ss[1]')} END END AS content,
         CASE WHEN asset_id IS NOT NULL THEN least(1000, base + 150) WHEN kind = 'equation' THEN least(1000, base + 100)
              ELSE base END AS importance_milli,
         CASE WHEN asset_id IS NULL AND kind IN ('paragraph', 'list_item', 'caption') AND base < 350 THEN 'script'
              ELSE 'slide' END AS channel
  FROM scored)"""


@query("segment_blocks", b.with_(b.LINES, SEGS, GROUPS, BLOCKS_SQL, body="""
SELECT doc_id, seg_no, type, content, importance_milli, channel FROM blk WHERE type IS NOT NULL"""))
def segment_blocks(spark, sf):
    d = pl.heading_groups(c.plan_documents(spark, sf))
    blocks = F.zip_with("segs", "groups", lambda s, g: F.struct(
        s["seg_no"].alias("seg_no"),
        pl.segment_block(s, cl.classify_by_keywords(g["title"], RUBRICS), None, CLAIMS, HEDGES).alias("b")))
    return (d.select("doc_id", F.explode(blocks).alias("r")).filter("r.b IS NOT NULL")
            .select("doc_id", "r.seg_no", "r.b.type", "r.b.content", "r.b.importance_milli", "r.b.channel"))


PACK = f"""sized AS (
  SELECT *, CASE WHEN kind IN ('paragraph', 'list_item') THEN {b.units('text')} ELSE 0 END AS u,
         CASE WHEN kind IN ('paragraph', 'list_item') THEN 1 ELSE 0 END AS c,
         kind <> 'heading' AND (kind = 'table' OR asset_id IS NOT NULL) AS fl FROM grp),
pk AS (
  SELECT doc_id, 0::BIGINT AS ord, 0::BIGINT AS seg_no, 0 AS page, 'none' AS open, NULL::VARCHAR AS asset, 0::BIGINT AS cnt,
         0::BIGINT AS units, 0::BIGINT AS title_at, false AS is_on, 0 AS no FROM docs
  UNION ALL
  SELECT doc_id, ord, seg_no, CASE WHEN kind <> 'heading' AND NOT same AND NOT joins THEN page + 1 ELSE page END,
         CASE WHEN kind = 'heading' THEN CASE WHEN op = 'float' THEN 'float' ELSE 'none' END WHEN fl THEN 'float'
              WHEN (CASE WHEN joins THEN cnt ELSE 0 END) + c >= @CAP@
                OR (CASE WHEN joins THEN units ELSE 0 END) + u >= @UNITS@ THEN 'none' ELSE 'text' END,
         CASE WHEN fl THEN asset_id ELSE asset END,
         CASE WHEN fl OR kind = 'heading' THEN 0 WHEN joins THEN cnt + c ELSE c END,
         CASE WHEN fl OR kind = 'heading' THEN 0 WHEN joins THEN units + u ELSE u END,
         CASE WHEN opens THEN 0 WHEN kind = 'heading' THEN ord WHEN moved THEN 0 ELSE title_at END,
         kind <> 'heading', new_no
  FROM (SELECT *, fl AND op = 'float' AND coalesce(asset_id = asset, false) AS same,
               kind <> 'heading' AND NOT fl AND op = 'text' AS joins
        FROM (SELECT s.doc_id, s.ord, s.seg_no, s.kind, s.fl, s.c, s.u, s.opens, s.asset_id, s.no AS new_no,
                     p.page, p.asset, p.cnt, p.units, p.title_at, s.no <> p.no AS moved,
                     CASE WHEN s.no <> p.no THEN 'none' ELSE p.open END AS op
              FROM pk p JOIN sized s ON s.doc_id = p.doc_id AND s.ord = p.ord + 1)))"""


def pack_sql(cap: int, units: int) -> str:
    return PACK.replace("@CAP@", str(cap)).replace("@UNITS@", str(units))


@query("page_pack", b.with_(b.LINES, SEGS, GROUPS, pack_sql(4, 72), recursive=True, body="""
SELECT doc_id, seg_no, page, CAST(title_at AS INTEGER) AS title_at FROM pk WHERE is_on"""))
def page_pack(spark, sf):
    d = pl.pack_pages(pl.heading_groups(c.plan_documents(spark, sf)), "sparse")
    rows = F.filter(F.zip_with("segs", "pages", lambda s, p: F.struct(
        s["seg_no"].alias("seg_no"), p["page"].alias("page"), p["title_at"].alias("title_at"), p["on"].alias("on"))),
        lambda r: r["on"])
    return d.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.seg_no", "r.page", "r.title_at")


_BASE = "coalesce((SELECT text FROM segs s WHERE s.doc_id = q.doc_id AND s.ord = q.title_at), nullif(gtitle, ''), title)"
_TIDY = b.strip("regexp_replace(raw_title, '^[0-9]+(?:[.][0-9]+)* *[.、]? *', '')")
MERGE = f"""onpage AS (
  SELECT p.doc_id, p.page, p.ord, p.no, p.title_at, p.is_on, bl.type, bl.content, bl.kind, bl.asset_id
  FROM pk p JOIN blk bl ON bl.doc_id = p.doc_id AND bl.ord = p.ord WHERE p.ord > 0),
pg0 AS (
  SELECT o.doc_id, page, any_value(no) FILTER (is_on AND ord = first_at) AS no,
         bool_or(is_on AND type IN ('figure', 'table')) AS visual,
         count(*) FILTER (is_on AND type NOT IN ('figure', 'table')) AS n,
         coalesce(sum({b.units("coalesce(content, '')")}) FILTER (is_on AND type NOT IN ('figure', 'table')), 0) AS units,
         bool_or(is_on AND type IS NOT NULL) AS has_any,
         arg_min(CASE WHEN kind = 'caption' AND asset_id IS NOT NULL THEN content END, ord)
           FILTER (is_on AND kind = 'caption' AND asset_id IS NOT NULL) AS cap
  FROM onpage o JOIN (SELECT doc_id, page, min(ord) AS first_at FROM onpage WHERE is_on GROUP BY ALL) f USING (doc_id, page)
  WHERE page > 0 GROUP BY o.doc_id, page),
pgt AS (
  SELECT p0.*, (SELECT max(title_at) FROM onpage o WHERE o.doc_id = p0.doc_id AND o.page = p0.page AND o.no = p0.no
                AND (o.is_on OR p0.visual)) AS title_at FROM pg0 p0 WHERE has_any),
pg1 AS (
  SELECT q.*, {_BASE} AS base_title FROM pgt q LEFT JOIN gtitles g ON g.doc_id = q.doc_id AND g.no = q.no
  JOIN docs d ON d.doc_id = q.doc_id),
pg2 AS (
  SELECT *, CASE WHEN cap IS NOT NULL AND visual AND len({b.strip("regexp_replace(cap, '^Table [0-9]+: ', '')")}) BETWEEN 2 AND 40
                 THEN {b.strip("regexp_replace(cap, '^Table [0-9]+: ', '')")} ELSE base_title END AS raw_title FROM pg1),
pages AS (
  SELECT *, CASE WHEN {_TIDY} = '' THEN '内容' ELSE {_TIDY} END AS ptitle,
         row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM pg2),
mg AS (
  SELECT doc_id, k, page, 1 AS final, no, ptitle, visual, n, units FROM pages WHERE k = 1
  UNION ALL
  SELECT doc_id, k, page, CASE WHEN fits THEN final ELSE final + 1 END, no, ptitle, visual,
         CASE WHEN fits THEN n + pn ELSE n END, CASE WHEN fits THEN units + pu ELSE units END
  FROM (SELECT p.doc_id, p.k, p.page, m.final, p.no, p.ptitle, p.visual, p.n, p.units, m.n AS pn, m.units AS pu,
               p.no = m.no AND p.ptitle = m.ptitle AND NOT p.visual AND NOT m.visual AND p.n + m.n <= @CAP@
                 AND p.units + m.units <= @UNITS@ AS fits
        FROM mg m JOIN pages p ON p.doc_id = m.doc_id AND p.k = m.k + 1))"""


@query("page_coalesce", b.with_(b.LINES, SEGS, GROUPS, BLOCKS_SQL, pack_sql(4, 72), MERGE.replace("@CAP@", "4").replace("@UNITS@", "72"),
                                recursive=True, body="""
SELECT p.doc_id, p.page, p.ptitle AS title, p.visual, p.n, CAST(p.units AS BIGINT) AS units, m.final
FROM pages p JOIN mg m USING (doc_id, k)"""))
def page_coalesce(spark, sf):
    d = pn.paged_documents(c.plan_documents(spark, sf), "sparse", None, CLAIMS, HEDGES, RUBRICS)
    rows = F.zip_with("page_list", "final", lambda p, f: F.struct(
        p["page"].alias("page"), p["title"].alias("title"), p["visual"].alias("visual"), p["n"].alias("n"),
        p["units"].cast("long").alias("units"), f["no"].alias("final")))
    return d.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


PLACED = """placed AS (
  SELECT o.doc_id, o.no AS section_no, m.final AS page, o.ord, bl.seg_no, o.type, o.content, bl.channel, bl.asset_id,
         bl.importance_milli, p.ptitle
  FROM onpage o JOIN blk bl ON bl.doc_id = o.doc_id AND bl.ord = o.ord
  JOIN pages p ON p.doc_id = o.doc_id AND p.page = o.page JOIN mg m ON m.doc_id = p.doc_id AND m.k = p.k
  JOIN front f ON f.doc_id = o.doc_id
  WHERE o.is_on AND o.type IS NOT NULL AND NOT (f.has_front AND o.no = 1)),
slides AS (
  SELECT doc_id, section_no, page, arg_min(ptitle, ord) AS title, count(*) AS segments,
         CASE WHEN bool_or(type = 'table') THEN 'table'
              WHEN bool_or(type = 'figure') AND bool_or(type = 'bullet' AND channel = 'slide') THEN 'text_figure'
              WHEN bool_or(type = 'figure') THEN 'big_figure' WHEN bool_or(type = 'equation') THEN 'equation'
              ELSE 'text_dense' END AS role
  FROM placed GROUP BY doc_id, section_no, page)"""

_PLAN = (b.LINES, SEGS, GROUPS, FRONT, BLOCKS_SQL, pack_sql(4, 72), MERGE.replace("@CAP@", "4").replace("@UNITS@", "72"), PLACED)


def planned(spark, sf):
    return pn.plan_documents(c.plan_documents(spark, sf), 900, "sparse", "grant_defense", None, CLAIMS, HEDGES, RUBRICS)


@query("plan_slides", b.with_(*_PLAN, recursive=True, body="SELECT * FROM slides"))
def plan_slides(spark, sf):
    return planned(spark, sf).slides


@query("plan_blocks", b.with_(*_PLAN, recursive=True, body="""
SELECT doc_id, section_no, page, asset_id, min(seg_no) AS seg_no, arg_min(type, seg_no) AS type,
       coalesce(arg_min(nullif(content, ''), seg_no) FILTER (content <> ''), '') AS content,
       max(importance_milli) AS importance_milli, count(*) AS spans FROM placed WHERE asset_id IS NOT NULL
GROUP BY doc_id, section_no, page, asset_id
UNION ALL SELECT doc_id, section_no, page, NULL, seg_no, type, content, importance_milli, 1 FROM placed
WHERE asset_id IS NULL"""))
def plan_blocks(spark, sf):
    return planned(spark, sf).blocks.withColumn("spans", F.size("spans").cast("long"))


SECTIONS_SQL = f"""secs AS (
  SELECT s.doc_id, s.section_no, count(*) AS pages, any_value(gtitle) AS heading, any_value(d.title) AS doc_title
  FROM slides s LEFT JOIN gtitles g ON g.doc_id = s.doc_id AND g.no = s.section_no JOIN docs d ON d.doc_id = s.doc_id
  GROUP BY s.doc_id, s.section_no),
named AS (
  SELECT *, coalesce(nullif(heading, ''), doc_title) AS title,
         {RUBRIC_SQL.format(t="coalesce(heading, '')")} AS rubric_key FROM secs),
ordered AS (
  SELECT *, CASE rubric_key WHEN 'innovation' THEN 2000 WHEN 'methods' THEN 1600 WHEN 'motivation' THEN 1200
              WHEN 'budget' THEN 500 ELSE 1000 END AS weight_milli,
         coalesce(rubric_key = 'budget', false) AS is_backup,
         CASE WHEN rubric_key = 'budget' THEN 0 ELSE pages END AS live_pages,
         row_number() OVER (PARTITION BY doc_id ORDER BY CASE rubric_key WHEN 'motivation' THEN 0 WHEN 'innovation' THEN 2
           WHEN 'methods' THEN 3 WHEN 'budget' THEN 9 ELSE 5 END, section_no) AS talk_no FROM named),
worth AS (
  SELECT *, NOT (pages > 0 AND live_pages = 0) AS presented,
         count(*) FILTER (NOT (pages > 0 AND live_pages = 0)) OVER (PARTITION BY doc_id) >= 4
           AND NOT (pages > 0 AND live_pages = 0) AND live_pages >= 2 AS w FROM ordered),
divided AS (
  SELECT *, CASE WHEN w THEN count(*) FILTER (w) OVER (PARTITION BY doc_id ORDER BY talk_no) END AS divider_no FROM worth)"""
_ORD = "['一','二','三','四','五','六','七','八','九','十','十一','十二','十三','十四','十五','十六','十七','十八']"
_LABEL = f"CASE WHEN divider_no <= 18 THEN {_ORD}[divider_no] || '、' || title WHEN divider_no IS NOT NULL THEN title END"


@query("section_order", b.with_(*_PLAN, SECTIONS_SQL, recursive=True, body=f"""
SELECT doc_id, section_no, title, rubric_key, weight_milli, is_backup, pages, talk_no, divider_no,
       {_LABEL} AS divider_title FROM divided"""))
def section_order(spark, sf):
    return planned(spark, sf).sections.select("doc_id", "section_no", "title", "rubric_key", "weight_milli", "is_backup",
                                              "pages", "talk_no", "divider_no", "divider_title")


@query("navigation_pages", b.with_(*_PLAN, SECTIONS_SQL, recursive=True, body=f"""
SELECT DISTINCT doc_id, 'cover' AS role, 0::BIGINT AS talk_no, doc_title AS title, 'A' || doc_id AS subtitle FROM divided
UNION ALL SELECT doc_id, 'agenda', 0, '汇报内容', NULL FROM divided WHERE presented GROUP BY doc_id HAVING count(*) >= 3
UNION ALL SELECT doc_id, 'section', talk_no, {_LABEL}, NULL FROM divided WHERE divider_no IS NOT NULL
UNION ALL SELECT DISTINCT doc_id, 'acknowledgement', NULL::BIGINT, '谢谢', '请各位专家批评指正' FROM divided"""))
def navigation_pages(spark, sf):
    return planned(spark, sf).navigation


@query("agenda_rows", b.with_(*_PLAN, SECTIONS_SQL, """
heads AS (SELECT doc_id, no AS section_no, max(seg_no) FILTER (opens) AS heading_seg FROM grp GROUP BY ALL)""",
                              recursive=True, body="""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY talk_no) AS block_no, title AS content,
       CASE WHEN heading_seg IS NOT NULL THEN 'verbatim' ELSE 'authored' END AS derivation, heading_seg
FROM (SELECT d.*, heading_seg, count(*) OVER (PARTITION BY d.doc_id) AS n FROM divided d
      LEFT JOIN heads USING (doc_id, section_no) WHERE presented) WHERE n >= 3"""))
def agenda_rows(spark, sf):
    return planned(spark, sf).agenda.select("doc_id", "block_no", "content", "derivation", "heading_seg")


@query("titles_distinguished", b.with_(b.LINES, body="""
SELECT doc_id, slide_no, CASE WHEN slide_no % 2 = 0 THEN 'other' WHEN contains(substr(line, 1, 300), 'und') THEN 'U'
   WHEN contains(substr(line, 1, 300), 'the') THEN 'T' ELSE 'same' END AS title FROM lines"""))
def titles_distinguished(spark, sf):
    title = F.when(F.col("slide_no") % 2 == 0, "other").otherwise("same")
    return c.lines(spark, sf).select("doc_id", "slide_no", cl.distinguish_title(
        title, F.lit("same"), "line", (("und", "U"),), (("the", "T"),)).alias("title"))


_BYLINE = "(?is)^(.*?)(?:" + cl.INSTITUTION + ")"


@query("affiliations", b.with_(b.LINES, f"""
two AS (SELECT doc_id, max(CASE WHEN slide_no = 1 THEN line END) AS a, coalesce(max(CASE WHEN slide_no = 2 THEN line END), '') AS n FROM lines GROUP BY doc_id),
l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN a || ', ' || n || ' University' WHEN 1 THEN '张三、李四 某大学 ' || a ELSE a || ' and ' || n END AS line FROM two),
p AS (SELECT *, regexp_matches(line, '{_BYLINE}') AS hit, regexp_extract(line, '{_BYLINE}', 1) AS pre FROM l),
q AS (SELECT *, len(regexp_extract(pre, '(?s)^(.*(?:\\x{{3000}}|  |[，,；;、]))', 1)) AS cut FROM p),
r AS (SELECT *, len(regexp_extract(substr(pre, cut + 1), '(?s)^(.* )', 1)) AS gap, substr(line, len(pre) + 1, 1) >= '⺀' AS cjk FROM q),
t AS (SELECT *, CASE WHEN cjk AND gap > 0 AND len({b.strip("substr(substr(pre, cut + 1), 1, gap - 1)")}) <= 8 THEN cut + gap ELSE cut END AS start FROM r)""", body=f"""
SELECT doc_id, CASE WHEN NOT hit OR {b.strip("substr(line, start + 1)")} = '' THEN {b.strip("line")} ELSE {b.strip("substr(line, start + 1)")} END AS affiliation FROM t"""))
def affiliations(spark, sf):
    """Bylines made of whole lines of the documents, with and without an institution in them."""
    d = c.documents(spark, sf).select("doc_id", F.split("text", "\n").alias("l"))
    a, n = F.col("l")[0], F.coalesce(F.get("l", F.lit(1)), F.lit(""))
    line = (F.when(F.col("doc_id") % 3 == 0, F.concat(a, F.lit(", "), n, F.lit(" University")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("张三、李四 某大学 "), a)).otherwise(F.concat(a, F.lit(" and "), n)))
    return d.select("doc_id", cl.affiliation_of(line).alias("affiliation"))
