"""Whole edit logs applied to whole tables: one patch per page, of all twenty kinds in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom.plans import replay as rp
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.session import cut_lineage
from briefloom.sources import corpus as c

KINDS = ("set_text", "rewrite", "split_block", "merge_blocks", "delete_block", "insert_block", "set_channel", "set_importance", "pin", "set_dwell", "retime",
         "move_block", "reorder_slides", "split_slide", "set_slide_role", "set_backup", "set_title", "replace_asset", "set_caption", "set_style")
WHOLE_PAGE = ("set_dwell", "retime", "reorder_slides", "set_slide_role", "set_backup", "set_title")


def decks(spark, sf) -> rp.Decks:
    """The numeric decks with words: a text per block, a title per page, one asset per deck."""
    text = lambda x: F.col(x).cast("string").alias(x)
    pages = c.num_slides(spark, sf).select(text("deck_uid"), "section_uid", text("slide_uid"), F.col("slide_no").cast("double").alias("slide_no"),
                                           F.concat(F.lit("p "), "slide_uid").alias("title"), "role", "is_backup", "dwell_seconds", "dwell_locked")
    blocks = c.numbered_blocks(c.num_blocks(spark, sf).select(*c.POSITION, "slide_uid", "block_uid", "type", "channel", "channel_pinned", "pinned",
                                                              "importance_milli", "derivation"))
    of = c.num_slides(spark, sf).select("slide_uid", text("deck_uid"))
    none = lambda kind: F.lit(None).cast(kind)
    blocks = blocks.join(of, "slide_uid").select(
        "deck_uid", text("slide_uid"), "block_uid", F.col("block_no").cast("long").alias("block_no"), "type", F.concat(F.lit("b "), "block_uid").alias("content"),
        "channel", "channel_pinned", "pinned", "importance_milli", "derivation", F.array().cast("array<struct<doc_id:string,start:int>>").alias("spans"),
        none("string").alias("speaker_note"), none("int").alias("word_budget"), none("string").alias("asset_ref"), F.array().cast("array<string>").alias("tags"))
    assets = c.num_decks(spark, sf).select(text("deck_uid"), F.concat(F.col("deck_uid").cast("string"), F.lit(":a")).alias("asset_uid"), F.lit("old").alias("caption"))
    meta = c.num_decks(spark, sf).select(text("deck_uid"), F.lit(300).alias("total_seconds"), none("string").alias("density"), none("double").alias("target_dwell_seconds"))
    sections = pages.select("deck_uid", "section_uid").distinct().withColumn("title", none("string"))
    return rp.Decks(cut_lineage(pages), cut_lineage(blocks), sections, assets, meta)


def log(d: rp.Decks) -> DataFrame:
    """One patch per page, its kind from the page's number; edits of a block name the page's first."""
    number = F.col("slide_uid").cast("long")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (number % 20 + 1).cast("int"))
    first = d.blocks.filter("block_no = 1").select("slide_uid", F.col("block_uid").alias("one"))
    second = d.blocks.filter("block_no = 2").select("slide_uid", F.col("block_uid").alias("two"))
    p = d.slides.join(first, "slide_uid", "left").join(second, "slide_uid", "left").withColumn("op", kind)
    op = F.col("op")
    target = (F.when(op == "retime", F.col("deck_uid")).when(op == "reorder_slides", F.col("section_uid"))
              .when(op.isin("set_dwell", "split_slide", "set_slide_role", "set_backup", "set_title"), F.col("slide_uid")).otherwise(F.col("one")))
    value = (F.when(op == "set_channel", "script").when(op == "set_importance", "900").when(op.isin("pin", "set_backup"), "true").when(op == "set_dwell", "30")
             .when(op == "set_slide_role", "two_column").otherwise(F.concat(F.lit("v "), "slide_uid")))
    only = lambda k, x: F.when(op == k, x)
    return (p.filter(op.isin(*WHOLE_PAGE) | F.col("one").isNotNull())
            .select("deck_uid", number.alias("seq"), F.lit(1).alias("op_no"), number.alias("patch_id"), "op", target.alias("target"), value.alias("value"),
                    only("delete_block", number % 40 == 4).alias("hard"), only("rewrite", F.lit(500)).alias("max_units"),
                    only("split_block", F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("parts"),
                    only("merge_blocks", F.array(F.coalesce("two", F.lit("nothing")))).alias("others"), only("move_block", F.col("slide_uid")).alias("to_slide"),
                    only("reorder_slides", F.array("slide_uid")).alias("order"), only("split_slide", F.col("one")).alias("after_block"),
                    only("replace_asset", F.concat("deck_uid", F.lit(":a"))).alias("asset_ref"), only("set_title", F.lit("sub")).alias("subtitle"),
                    only("set_slide_role", F.lit("wide")).alias("layout_hint"), only("retime", (400 + number % 100).cast("int")).alias("total_seconds"),
                    only("set_style", F.lit(12.0)).alias("font_size_pt"), only("set_style", F.lit("bold")).alias("emphasis")))


def shown(d: rp.Decks, before: rp.Decks, refused: DataFrame) -> DataFrame:
    """Every node and its state as text; pages the log made are called new."""
    said = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("-"))
    old = before.slides.select("slide_uid", F.lit(True).alias("old"))
    pages = d.slides.join(old, "slide_uid", "left").withColumn("page", F.when(F.col("old"), F.col("slide_uid")).otherwise("new"))
    place = F.row_number().over(Window.partitionBy("section_uid").orderBy("slide_no"))
    slides = pages.withColumn("place", place).withColumn("named", F.when(F.col("old"), F.col("title")).otherwise("-"))
    blocks = d.blocks.join(pages.select("slide_uid", "page"), "slide_uid").withColumn("tag", F.array_join("tags", ","))
    row = lambda df, node, uid, *cols: df.select(F.lit(node).alias("node"), F.col(uid).cast("string").alias("uid"), F.concat_ws("|", *map(said, cols)).alias("state"))
    return (row(slides, "slide", "page", "section_uid", "place", "named", "subtitle", "role", "layout_hint", "is_backup", "dwell_seconds", "dwell_locked")
            .unionByName(row(blocks, "block", "content", "page", "block_no", "type", "channel", "channel_pinned", "pinned", "importance_milli", "derivation", "asset_ref", "tag"))
            .unionByName(row(d.decks, "deck", "deck_uid", "total_seconds")).unionByName(row(refused, "refused", "patch_id", "deck_uid")))


@query("apply_log", b.with_(b.SLIDES, b.BLOCKS, """
cnt AS (SELECT slide_uid, count(*) AS n, bool_or(block_no = 1 AND is_visual) AS seen FROM blocks GROUP BY slide_uid),
sec AS (SELECT section_uid, count(*) AS pages FROM slides GROUP BY section_uid),
p AS (
  SELECT s.*, s.slide_uid % 20 AS kind, n, CASE s.slide_uid % 20 WHEN 3 THEN n < 2 WHEN 6 THEN seen WHEN 12 THEN pages > 1 WHEN 13 THEN n < 2
           WHEN 17 THEN NOT seen WHEN 18 THEN NOT seen ELSE false END AS bad
  FROM slides s LEFT JOIN cnt USING (slide_uid) JOIN sec USING (section_uid)),
live AS (SELECT *, CASE WHEN bad OR (n IS NULL AND kind NOT IN (9, 10, 12, 14, 15, 16)) THEN -1 ELSE kind END AS k FROM p),
old AS (
  SELECT slide_uid, k, n, CAST(slide_uid AS VARCHAR) AS page, block_no AS no, block_no, type, 'b ' || block_uid AS content, channel, false AS fixed, pinned, importance_milli AS imp,
         derivation, '-' AS asset, '' AS tag, deck_uid, lead('b ' || block_uid) OVER (PARTITION BY slide_uid ORDER BY block_no) AS below
  FROM blocks JOIN live USING (slide_uid)),
first AS (
  SELECT CASE WHEN k = 11 THEN n ELSE 1 END AS no, page, type, CASE WHEN k IN (0, 18) THEN 'v ' || slide_uid WHEN k = 2 THEN part WHEN k = 3 THEN content || '; ' || below ELSE content END AS content,
         CASE WHEN k = 4 THEN 'drop' WHEN k = 6 THEN 'script' ELSE channel END AS channel, k = 6 AS fixed, pinned OR k = 8 AS pinned, CASE WHEN k = 7 THEN 900 ELSE imp END AS imp,
         CASE WHEN k = 0 AND derivation IN ('verbatim', 'compressed') THEN 'authored' ELSE derivation END AS derivation,
         CASE WHEN k = 17 THEN deck_uid || ':a' ELSE asset END AS asset, CASE WHEN k = 19 THEN 'size:12,emphasis:bold' ELSE tag END AS tag, nth
  FROM (SELECT old.*, unnest(CASE WHEN k = 2 THEN ['x', 'y', 'z'] ELSE [''] END) AS part, unnest(CASE WHEN k = 2 THEN [0, 1, 2] ELSE [0] END) AS nth FROM old WHERE block_no = 1)
  WHERE NOT (k = 4 AND slide_uid % 40 = 4)),
rest AS (
  SELECT CASE k WHEN 2 THEN no + 2 WHEN 3 THEN no - 1 WHEN 4 THEN CASE WHEN slide_uid % 40 = 4 THEN no - 1 ELSE no END WHEN 5 THEN no + 1 WHEN 11 THEN no - 1 WHEN 13 THEN no - 1 ELSE no END AS no,
         CASE WHEN k = 13 THEN 'new' ELSE page END AS page, type, content, channel, fixed, pinned, imp, derivation, asset, tag, 0 AS nth
  FROM old WHERE block_no > 1 AND NOT (k = 3 AND block_no = 2)),
new AS (SELECT 2 AS no, page, 'bullet' AS type, 'v ' || slide_uid AS content, 'slide' AS channel, false AS fixed, false AS pinned, 500 AS imp, 'authored' AS derivation, '-' AS asset, '-' AS tag, 0 AS nth
        FROM old WHERE block_no = 1 AND k = 5),
every AS (SELECT * FROM first UNION ALL SELECT * FROM rest UNION ALL SELECT * FROM new),
pages AS (
  SELECT section_uid, slide_uid, 0 AS cut, CAST(slide_uid AS VARCHAR) AS page, CASE WHEN k = 16 THEN 'v ' || slide_uid ELSE 'p ' || slide_uid END AS title, CASE WHEN k = 16 THEN 'sub' ELSE '-' END AS sub,
         CASE WHEN k = 14 THEN 'two_column' ELSE role END AS role, CASE WHEN k = 14 THEN 'wide' ELSE '-' END AS hint, is_backup OR k = 15 AS backup,
         CASE WHEN k = 9 THEN '30.0' WHEN dwell_locked THEN '20.0' ELSE '-' END AS dwell, dwell_locked OR k = 9 AS locked FROM live
  UNION ALL SELECT section_uid, slide_uid, 1, 'new', '-', '-', role, '-', is_backup, '-', false FROM live WHERE k = 13)""", body="""
SELECT 'block' AS node, content AS uid, concat_ws('|', page, no + nth, type, channel, fixed, pinned, imp, derivation, asset, tag) AS state FROM every
UNION ALL SELECT 'slide', page, concat_ws('|', section_uid, row_number() OVER (PARTITION BY section_uid ORDER BY slide_uid, cut), title, sub, role, hint, backup, dwell, locked) FROM pages
UNION ALL SELECT 'deck', CAST(c_custkey AS VARCHAR), CAST(coalesce((SELECT 400 + max(slide_uid) % 100 FROM live WHERE k = 10 AND deck_uid = c_custkey), 300) AS VARCHAR) FROM customer
UNION ALL SELECT 'refused', CAST(slide_uid AS VARCHAR), CAST(deck_uid AS VARCHAR) FROM p WHERE bad AND (n IS NOT NULL OR kind IN (9, 10, 12, 14, 15, 16))"""))
def apply_log(spark, sf):
    d = decks(spark, sf)
    after, refused = rp.apply_patches(d, log(d))
    return shown(after, d, refused)
