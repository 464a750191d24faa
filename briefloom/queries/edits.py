"""Edit-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import text as tx
from briefloom.operators import edits as ed
from briefloom.operators import model as md
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.sources import corpus as c


@query("latest_values", b.with_(b.EDITS, """
f AS (SELECT *, CASE op WHEN 'set_importance' THEN 'importance' WHEN 'pin' THEN 'pinned' WHEN 'retime' THEN 'total_seconds'
             ELSE 'channel' END AS field FROM edits)""", body="""
SELECT deck_uid, target, field, arg_max(value, seq) AS value, max(seq) AS seq, count(*) AS edits FROM f GROUP BY ALL"""))
def latest_values(spark, sf):
    return ed.latest_values(c.edits(spark, sf))


CUTS = "cuts AS (SELECT user_id AS deck_uid, max(event_id) AS patch_id FROM events WHERE event_id % 3 = 0 GROUP BY user_id)"


@query("truncate_log", b.with_(b.EDITS, CUTS, body="""
SELECT e.deck_uid, e.seq FROM edits e LEFT JOIN cuts c ON c.deck_uid = e.deck_uid AND e.deck_uid % 2 = 0
WHERE c.patch_id IS NULL OR e.seq <= c.patch_id"""))
def truncate_log(spark, sf):
    e = c.edits(spark, sf)
    cuts = e.filter("seq % 3 = 0 AND deck_uid % 2 = 0").groupBy("deck_uid").agg(F.max("patch_id").alias("patch_id"))
    return ed.truncate_after(e, cuts).select("deck_uid", "seq")


@query("unknown_cuts", b.with_(b.EDITS, body="""
SELECT c_custkey AS deck_uid, c_custkey * 7 AS patch_id FROM customer
WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.deck_uid = c_custkey AND e.patch_id = c_custkey * 7)"""))
def unknown_cuts(spark, sf):
    cuts = c.num_decks(spark, sf).select("deck_uid", (F.col("deck_uid") * 7).alias("patch_id"))
    return ed.unknown_cuts(c.edits(spark, sf), cuts)


@query("blast_radius", b.with_(b.EDITS, body="""
SELECT DISTINCT deck_uid, patch_id // 10 AS patch_id, unnest(CASE WHEN seq % 5 = 0
  THEN [CAST(target AS VARCHAR), CAST(target + 1 AS VARCHAR), CAST(target + 2 AS VARCHAR)] ELSE [CAST(target AS VARCHAR)] END) AS uid
FROM edits"""))
def blast_radius(spark, sf):
    t = F.col("target")
    e = c.edits(spark, sf).withColumn("patch_id", F.floor(F.col("patch_id") / 10)).withColumn(
        "others", F.when(F.col("seq") % 5 == 0, F.array(t + 1, t + 2)))
    return ed.affected(e)


@query("reallocation_decks", b.with_(b.EDITS, body="""
SELECT deck_uid, bool_or(op IN ('set_channel', 'set_importance', 'retime')) AS reallocate, count(DISTINCT patch_id) AS patches
FROM edits GROUP BY deck_uid"""))
def reallocation_decks(spark, sf):
    return ed.needs_reallocation(c.edits(spark, sf))


@query("edit_history", b.with_(b.EDITS, body="""
SELECT deck_uid, row_number() OVER (PARTITION BY deck_uid ORDER BY seq) AS no, patch_id, strftime(created_at, '%H:%M:%S') AS time,
       CASE WHEN seq % 4 = 0 THEN 'say ' || seq ELSE '1 op(s)' END AS label FROM edits"""))
def edit_history(spark, sf):
    e = c.edits(spark, sf).withColumn("utterance", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("say "), "seq")))
    return ed.history(e)


@query("gate_split", b.with_(b.EDITS, body="""
SELECT deck_uid, patch_id, CASE WHEN patch_id % 7 = 0 THEN 'refuse' WHEN confidence_pct >= 75 THEN 'apply' ELSE 'confirm' END AS decision
FROM edits"""))
def gate_split(spark, sf):
    e = c.edits(spark, sf).withColumn("op", F.when(F.col("patch_id") % 7 != 0, F.col("op")))
    return ed.confidence_gate(e).select("deck_uid", "patch_id", "decision")


@query("confirmation_rate", b.with_(b.EDITS, body="""
SELECT deck_uid, count(*) AS n, round(avg(CASE WHEN confidence_pct < 75 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS needs_confirmation
FROM edits GROUP BY deck_uid"""))
def confirmation_rate(spark, sf):
    return ed.confirmation_rate(c.edits(spark, sf))


REJECT = """nodes AS (
  SELECT deck_uid, t AS target, CASE WHEN t < 80 THEN 'block' ELSE 'slide' END AS kind, t % 10 = 0 AS vis
  FROM (SELECT DISTINCT deck_uid FROM edits), (SELECT unnest(range(0, 90)) AS t)),
ops AS (SELECT deck_uid, seq, seq // 3 AS patch_id, target, op, value FROM edits),
judged AS (
  SELECT o.*, CASE WHEN op = 'retime' AND kind IS NOT NULL THEN 'retime targets the deck' WHEN kind IS NULL THEN 'no such node'
    WHEN kind <> 'block' THEN 'slide where a block is needed'
    WHEN op = 'set_channel' AND vis AND value = 'script' THEN 'a visual cannot be spoken'
    WHEN op = 'set_importance' AND CAST(value AS DOUBLE) NOT BETWEEN 0 AND 1000 THEN 'importance out of range' END AS reason
  FROM ops o LEFT JOIN nodes n ON n.deck_uid = o.deck_uid AND n.target = o.target)"""


def _reject(spark, sf):
    e = c.edits(spark, sf).withColumn("patch_id", F.floor(F.col("seq") / 3))
    t = F.col("uid")
    nodes = e.select("deck_uid").distinct().withColumn("uid", F.explode(F.sequence(F.lit(0), F.lit(89)).cast("array<bigint>")))
    nodes = nodes.withColumn("kind", F.when(t < 80, "block").otherwise("slide")).withColumn("is_visual", t % 10 == 0)
    return ed.reject_invalid(e, nodes)


@query("ops_rejected", b.with_(b.EDITS, REJECT, body="SELECT deck_uid, seq, reason FROM judged WHERE reason IS NOT NULL"))
def ops_rejected(spark, sf):
    return _reject(spark, sf)[1].select("deck_uid", "seq", "reason")


@query("ops_accepted", b.with_(b.EDITS, REJECT, body="""
SELECT deck_uid, seq FROM judged j WHERE NOT EXISTS (
  SELECT 1 FROM judged k WHERE k.deck_uid = j.deck_uid AND k.patch_id = j.patch_id AND k.reason IS NOT NULL)"""))
def ops_accepted(spark, sf):
    return _reject(spark, sf)[0].select("deck_uid", "seq")


# ------------------------------------------------------------------ set-wise edits


def text_blocks(spark, sf):
    """Sentences as blocks of line slides, with string uids."""
    s = c.sentence_blocks(spark, sf)
    slide = F.concat_ws(".", "doc_id", "slide_no")
    return s.select(slide.alias("slide_uid"), F.concat_ws(".", slide, F.col("block_no")).alias("block_uid"), "block_no", "content",
                    F.lit("verbatim").alias("derivation"), F.lit("slide").alias("channel"), F.lit("bullet").alias("type"),
                    F.array(F.struct(F.col("doc_id"), F.col("block_no").alias("start"))).alias("spans"),
                    F.lit(None).cast("string").alias("speaker_note"), F.lit(12).alias("word_budget"),
                    F.array(F.lit("size:10"), F.lit("keep")).alias("tags"), "doc_id", "slide_no")


TB = b.SENTS + """,
tb AS (SELECT doc_id || '.' || slide_no AS slide_uid, doc_id || '.' || slide_no || '.' || block_no AS block_uid, block_no, content,
              doc_id, slide_no FROM sents)"""


@query("set_text", b.with_(TB, body="""
SELECT block_uid, CASE WHEN block_no = 2 THEN 'new ' || slide_no ELSE content END AS content,
       CASE WHEN block_no = 2 THEN 'authored' ELSE 'verbatim' END AS derivation FROM tb"""))
def set_text(spark, sf):
    t = text_blocks(spark, sf)
    hit = t.filter("block_no = 2")
    first = hit.select(F.lit(1).alias("seq"), F.lit(1).alias("op_no"), F.col("block_uid").alias("target"), F.lit("old").alias("value"))
    last = hit.select(F.lit(2).alias("seq"), F.lit(1).alias("op_no"), F.col("block_uid").alias("target"),
                      F.concat(F.lit("new "), "slide_no").alias("value"))
    return ed.set_text(t, first.unionByName(last)).select("block_uid", "content", "derivation")


@query("rewrite_blocks")
def rewrite_blocks(spark, sf):
    """Every first sentence cut to eight units; checked against a plain rendering of the rule in the tests."""
    t = text_blocks(spark, sf)
    ops = t.filter("block_no = 1").select(F.col("block_uid").alias("target"), F.lit(8).alias("max_units"), F.lit(True).alias("preserve_spans"))
    return ed.rewrite(t, ops).select("block_uid", "content", "speaker_note", "derivation", "outcome")


@query("split_blocks", b.with_(TB, """
parts AS (SELECT slide_uid, block_uid, block_no, unnest(CASE WHEN block_no = 2 THEN ['a', 'b ' || slide_no, 'c'] ELSE [content] END) AS content,
                 unnest(CASE WHEN block_no = 2 THEN [1, 2, 3] ELSE [1] END) AS k FROM tb)""", body="""
SELECT slide_uid, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no, k) AS block_no, content FROM parts"""))
def split_blocks(spark, sf):
    t = text_blocks(spark, sf)
    ops = t.filter("block_no = 2").select(F.col("block_uid").alias("target"), F.array(
        F.lit("a"), F.concat(F.lit("b "), "slide_no"), F.lit(" c ")).alias("parts"))
    return ed.split_blocks(t, ops)[0].select("slide_uid", "block_no", "content")


@query("merge_blocks", b.with_(TB, """
m AS (SELECT slide_uid, string_agg(content, '; ' ORDER BY block_no) AS joined, count(*) AS n FROM tb WHERE block_no <= 3 GROUP BY slide_uid),
r AS (SELECT t.slide_uid, t.block_no, CASE WHEN t.block_no = 1 AND n = 3 THEN joined ELSE content END AS content,
             CASE WHEN t.block_no = 1 AND n = 3 THEN 'synthesized' ELSE 'verbatim' END AS derivation
      FROM tb t JOIN m USING (slide_uid) WHERE NOT (n = 3 AND t.block_no IN (2, 3)))""", body="""
SELECT slide_uid, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no) AS block_no, content, derivation FROM r"""))
def merge_blocks(spark, sf):
    t = text_blocks(spark, sf)
    others = F.array(F.concat("slide_uid", F.lit(".2")), F.concat("slide_uid", F.lit(".3")))
    ops = t.filter("block_no = 1").select(F.col("block_uid").alias("op_id"), F.col("block_uid").alias("target"), others.alias("others"))
    return ed.merge_blocks(t, ops)[0].select("slide_uid", "block_no", "content", "derivation")


@query("delete_blocks", b.with_(TB, """
r AS (SELECT slide_uid, block_no, content, CASE WHEN block_no = 3 THEN 'drop' ELSE 'slide' END AS channel FROM tb WHERE block_no <> 2)""",
                                body="""
SELECT slide_uid, row_number() OVER (PARTITION BY slide_uid ORDER BY block_no) AS block_no, content, channel FROM r"""))
def delete_blocks(spark, sf):
    t = text_blocks(spark, sf)
    ops = t.filter("block_no IN (2, 3)").select(F.col("block_uid").alias("target"), (F.col("block_no") == 2).alias("hard"))
    return ed.delete_blocks(t, ops).select("slide_uid", "block_no", "content", "channel")


@query("insert_blocks", b.with_(TB, """
r AS (SELECT slide_uid, block_no AS p, 0 AS s, content FROM tb
      UNION ALL SELECT slide_uid, block_no, -1, 'before ' || block_no FROM tb WHERE block_no = 2
      UNION ALL SELECT slide_uid, max(block_no), 1, 'last' FROM tb GROUP BY slide_uid, slide_no HAVING slide_no % 2 = 0)""", body="""
SELECT slide_uid, row_number() OVER (PARTITION BY slide_uid ORDER BY p, s) AS block_no, content FROM r"""))
def insert_blocks(spark, sf):
    t = text_blocks(spark, sf)
    none = F.array().cast("array<struct<doc_id:bigint,start:bigint>>")

    def op(df, i, target, position, content, derivation):
        return df.select(F.lit(i).cast("long").alias("op_id"), target.alias("target"), F.lit(position).alias("position"),
                         content.alias("content"), F.lit("bullet").alias("type"), F.lit(derivation).alias("derivation"),
                         F.lit("slide").alias("channel"), none.alias("spans"))

    two = t.filter("block_no = 2")
    one = t.filter("block_no = 1 AND slide_no % 2 = 0")
    ops = (op(two, 1, F.col("block_uid"), "before", F.concat(F.lit("before "), "block_no"), "authored")
           .unionByName(op(one, 2, F.col("slide_uid"), "append", F.lit("last"), "inferred"))
           .unionByName(op(two, 3, F.col("block_uid"), "after", F.lit("refused"), "verbatim")))
    return ed.insert_blocks(t, ops)[0].select("slide_uid", "block_no", "content")


@query("move_blocks", b.with_(TB, """
nx AS (SELECT DISTINCT slide_uid FROM tb),
r AS (SELECT CASE WHEN block_no = 1 AND slide_no % 2 = 1 AND doc_id || '.' || (slide_no + 1) IN (SELECT slide_uid FROM nx)
                  THEN doc_id || '.' || (slide_no + 1) ELSE slide_uid END AS s2, block_uid, block_no,
             block_no = 1 AND slide_no % 2 = 1 AND doc_id || '.' || (slide_no + 1) IN (SELECT slide_uid FROM nx) AS moved FROM tb)""",
                              body="""
SELECT s2 AS slide_uid, block_uid, row_number() OVER (PARTITION BY s2 ORDER BY CASE WHEN moved THEN 1.5 ELSE block_no END, block_uid) AS block_no FROM r"""))
def move_blocks(spark, sf):
    t = text_blocks(spark, sf)
    nxt = F.concat_ws(".", "doc_id", F.col("slide_no") + 1)
    ops = t.filter("block_no = 1 AND slide_no % 2 = 1").select(F.col("block_uid").alias("target"), nxt.alias("to_slide"), F.lit(1).alias("index"))
    ops = ops.join(t.select(F.col("slide_uid").alias("to_slide")).distinct(), "to_slide", "left_semi")
    return ed.move_blocks(t, ops).select("slide_uid", "block_uid", "block_no")


def line_slides(spark, sf):
    uid = F.concat_ws(".", "doc_id", "slide_no")
    return c.lines(spark, sf).select(F.col("doc_id").alias("section_uid"), uid.alias("slide_uid"), "slide_no",
                                     F.substring("line", 1, 12).alias("title"))


@query("reorder_check", b.with_(b.LINES, """
s AS (SELECT doc_id, slide_no, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)""", body="""
SELECT doc_id || '.' || slide_no AS slide_uid, CASE WHEN doc_id % 3 = 0 THEN n + 1 - slide_no ELSE slide_no END AS slide_no FROM s"""))
def reorder_check(spark, sf):
    """One document in three reversed; another lists a foreign slide and is refused."""
    s = line_slides(spark, sf)
    n = F.size(F.split("text", "\n"))
    d = c.documents(spark, sf)
    rev = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.concat_ws(".", F.col("doc_id"), i))
    order = F.when(F.col("doc_id") % 3 == 0, rev).otherwise(F.concat(rev, F.array(F.lit("elsewhere"))))
    ops = d.filter("doc_id % 3 <> 2").select(F.col("doc_id").alias("target"), order.alias("order"))
    return ed.reorder_slides(s, ops)[0].select("slide_uid", "slide_no")


@query("reorder_refused", b.with_(b.LINES, body="""
SELECT doc_id AS target, 1 AS omitted, 1 AS "foreign" FROM documents WHERE doc_id % 3 = 1"""))
def reorder_refused(spark, sf):
    s = line_slides(spark, sf)
    n = F.size(F.split("text", "\n"))
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.col("doc_id"), i))
    bad = F.concat(F.slice(ids, F.lit(2), n), F.array(F.lit("elsewhere")))
    ops = c.documents(spark, sf).select(F.col("doc_id").alias("target"), F.when(F.col("doc_id") % 3 == 1, bad).otherwise(ids).alias("order"))
    return ed.reorder_slides(s, ops)[1]


@query("split_slides", b.with_(TB, """
cnt AS (SELECT slide_uid, max(block_no) AS last FROM tb GROUP BY slide_uid)""", body="""
SELECT block_uid, CASE WHEN last > 2 AND block_no > 2 THEN block_no - 2 ELSE block_no END AS block_no, last > 2 AND block_no > 2 AS moved
FROM tb JOIN cnt USING (slide_uid)"""))
def split_slides(spark, sf):
    t = text_blocks(spark, sf)
    ops = t.filter("block_no = 1").select(F.col("slide_uid").alias("target"), F.concat("slide_uid", F.lit(".2")).alias("after_block"))
    _, blocks, _ = ed.split_slides(line_slides(spark, sf), t, ops)
    return blocks.select("block_uid", "block_no", F.col("slide_uid").startswith("sld_").alias("moved"))


@query("style_tags", b.with_(TB, body="""
SELECT block_uid, CASE WHEN block_no = 1 THEN 'keep,size:14,emphasis:bold' ELSE 'size:10,keep' END AS tags FROM tb"""))
def style_tags(spark, sf):
    t = text_blocks(spark, sf)
    ops = t.filter("block_no = 1").select(F.lit(1).alias("seq"), F.lit(1).alias("op_no"), F.col("block_uid").alias("target"),
                                          F.lit(14.0).alias("font_size_pt"), F.lit("bold").alias("emphasis"))
    return ed.set_style(t, ops).select("block_uid", F.array_join("tags", ",").alias("tags"))


@query("assets_replaced", b.with_(b.BLOCKS, b.ASSETS, body="""
SELECT block_uid, CASE WHEN is_visual AND part_key % 3 = 0 AND part_key + 1 IN (SELECT asset_uid FROM assets) THEN part_key + 1
  ELSE asset_ref END AS asset_ref FROM blocks"""))
def assets_replaced(spark, sf):
    t = c.num_blocks(spark, sf)
    ops = t.filter("part_key % 3 = 0").select(F.lit(1).alias("seq"), F.lit(1).alias("op_no"), F.col("block_uid").alias("target"),
                                              (F.col("part_key") + 1).alias("asset_ref"))
    return ed.replace_assets(t, ops, c.num_assets(spark, sf))[0].select("block_uid", "asset_ref")


# ------------------------------------------------------------- fingerprints, diffs

AFTER = """after_b AS (
  SELECT slide_uid, block_uid, block_no, importance_milli, pinned,
         CASE WHEN slide_uid % 7 = 0 THEN units + 1 ELSE units END AS units,
         CASE WHEN slide_uid % 19 = 0 THEN CASE channel WHEN 'slide' THEN 'script' ELSE 'slide' END ELSE channel END AS channel
  FROM blocks WHERE slide_uid % 17 <> 0)"""


def after_blocks(t):
    s = F.col("slide_uid")
    return (t.filter(s % 17 != 0).withColumn("units", F.when(s % 7 == 0, F.col("units") + 1).otherwise(F.col("units")))
            .withColumn("channel", F.when(s % 19 == 0, F.when(F.col("channel") == "slide", "script").otherwise("slide"))
                        .otherwise(F.col("channel"))))


@query("diff_blocks", b.with_(b.BLOCKS, AFTER, body="""
SELECT b.block_uid, unnest(list_filter([CASE WHEN a.block_uid IS NULL THEN 'structure' END,
   CASE WHEN a.units <> b.units THEN 'text' END, CASE WHEN a.channel <> b.channel THEN 'channel' END], lambda x: x IS NOT NULL)) AS kind
FROM blocks b LEFT JOIN after_b a USING (block_uid)"""))
def diff_blocks(spark, sf):
    t = c.num_blocks(spark, sf)

    def view(d):
        return d.withColumn("content", F.col("units").cast("string"))

    return ed.diff_blocks(view(t), view(after_blocks(t))).select("block_uid", "kind")


DWELL = """before_s AS (SELECT *, 10.0::DOUBLE + slide_uid % 30 AS d FROM slides),
after_s AS (SELECT *, 10.0::DOUBLE + slide_uid % 30 + CASE WHEN slide_uid % 3 = 0 THEN 1.5 ELSE 0.4 END AS d,
  CASE WHEN slide_uid % 23 = 0 THEN 'table' ELSE role END AS r2 FROM slides WHERE slide_uid % 17 <> 0),
ch AS (
  SELECT b.deck_uid, b.slide_uid, unnest(list_filter([CASE WHEN a.slide_uid IS NULL THEN 'structure' END,
    CASE WHEN a.r2 <> b.role THEN 'structure' END, CASE WHEN abs(a.d - b.d) >= 1 THEN 'timing' END], lambda x: x IS NOT NULL)) AS kind
  FROM before_s b LEFT JOIN after_s a USING (slide_uid)),
sided AS (SELECT *, kind = 'timing' AND slide_uid % 6 <> 0 AS side,
                 count(*) FILTER (kind = 'timing' AND slide_uid % 6 <> 0) OVER (PARTITION BY deck_uid) AS n FROM ch)"""


def slide_diff(spark, sf):
    s = c.num_slides(spark, sf).withColumn("title", F.concat(F.lit("S"), "slide_uid"))
    u = F.col("slide_uid")
    before = s.withColumn("dwell_seconds", F.lit(10.0) + u % 30)
    after = (before.filter(u % 17 != 0)
             .withColumn("dwell_seconds", F.col("dwell_seconds") + F.when(u % 3 == 0, 1.5).otherwise(0.4))
             .withColumn("role", F.when(u % 23 == 0, "table").otherwise(F.col("role"))))
    focus = s.filter(u % 6 == 0).select("slide_uid")
    return ed.fold_timing(ed.diff_slides(before, after), focus)


@query("diff_slides", b.with_(b.SLIDES, DWELL, body="SELECT deck_uid, slide_uid, kind FROM sided WHERE NOT (side AND n > 3)"))
def diff_slides(spark, sf):
    return slide_diff(spark, sf)[0].select("deck_uid", "slide_uid", "kind")


@query("timing_folded", b.with_(b.SLIDES, DWELL, body="""
SELECT deck_uid, count(*) AS retimed FROM sided WHERE side AND n > 3 GROUP BY deck_uid"""))
def timing_folded(spark, sf):
    return slide_diff(spark, sf)[1]


@query("diff_decks", """
SELECT c_custkey AS deck_uid, 'meta' AS kind, (300 + 60 * (c_custkey % 10)) || 's' AS before, (360 + 60 * (c_custkey % 10)) || 's' AS "after", '总时长' AS note
FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'meta', ['sparse', 'balanced', 'compact'][c_custkey % 3 + 1], 'sparse', '版面密度' FROM customer
WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 0""")
def diff_decks(spark, sf):
    d = c.num_decks(spark, sf)
    k = F.col("deck_uid")
    later = d.withColumn("total_seconds", F.when(k % 5 == 0, F.col("total_seconds") + 60).otherwise(F.col("total_seconds"))).withColumn(
        "density", F.when(k % 4 == 0, "sparse").otherwise(F.col("density")))
    return ed.diff_deck_meta(d, later)


def _fp(expr: str) -> str:
    return f"substr(sha256({expr}), 1, 16)"


FP = f"""kids AS (SELECT slide_uid, sum(CAST('0x' || substr(sha256(block_no || ':' || block_uid), 1, 8) AS BIGINT)) AS k FROM {{t}} GROUP BY slide_uid),
fp AS (SELECT CAST(slide_uid AS VARCHAR) AS uid, {_fp(_fp("role || '|' || is_backup") + " || '|' || coalesce(CAST(k AS VARCHAR), '0')")} AS digest
       FROM slides LEFT JOIN kids USING (slide_uid)
       UNION ALL SELECT block_uid, {_fp("units || '|' || channel")} FROM {{t}})"""
FP_BEFORE = FP.replace("{t}", "blocks").replace("kids", "kids_b").replace("fp AS", "fp_b AS")
FP_AFTER = FP.replace("{t}", "after_n").replace("kids", "kids_a").replace("fp AS", "fp_a AS")
AFTER_N = """after_n AS (SELECT * EXCLUDE (block_no), row_number() OVER (PARTITION BY slide_uid ORDER BY block_no) AS block_no
  FROM after_b WHERE NOT (slide_uid % 23 = 0 AND block_no = 2))"""


def _fps(spark, sf):
    t = c.deck_tables(spark, sf)
    large = c.large_slides(spark, sf)
    before = c.placed_blocks(spark, sf, large)
    gone = after_blocks(before).filter("NOT (slide_uid % 23 = 0 AND block_no = 2)").drop("block_no")
    after = c.numbered_blocks(gone, large)
    # uids and places come from the untouched line item, so edits of the text do not move them
    fields = (("role", "is_backup"), ("units", "channel"))
    return ed.node_fingerprints(t.slides, before, *fields), ed.node_fingerprints(t.slides, after, *fields), t


@query("node_fingerprints", b.with_(b.SLIDES, b.BLOCKS, FP_BEFORE, body="SELECT uid, digest FROM fp_b"))
def node_fingerprints(spark, sf):
    return _fps(spark, sf)[0]


@query("containment", b.with_(b.SLIDES, b.BLOCKS, AFTER, AFTER_N, FP_BEFORE, FP_AFTER, """
chg AS (SELECT coalesce(x.uid, y.uid) AS uid, CASE WHEN y.uid IS NULL THEN 'removed' WHEN x.digest <> y.digest THEN 'changed' END AS change
        FROM fp_b x LEFT JOIN fp_a y ON x.uid = y.uid),
allowed AS (SELECT block_uid AS uid FROM blocks WHERE slide_uid % 7 = 0
            UNION SELECT uid FROM chg WHERE change = 'removed'
            UNION SELECT CAST(slide_uid AS VARCHAR) FROM blocks WHERE block_uid IN (SELECT uid FROM chg WHERE change = 'removed'))""",
                              body="SELECT uid, change FROM chg WHERE change IS NOT NULL AND uid NOT IN (SELECT uid FROM allowed)"))
def containment(spark, sf):
    before, after, t = _fps(spark, sf)
    declared = t.blocks.filter("slide_uid % 7 = 0").select(F.col("block_uid").alias("uid"))
    return ed.containment_violations(before, after, declared, md.ancestors(t.slides, t.blocks))


@query("apply_report", b.with_(b.SLIDES, b.BLOCKS, AFTER, AFTER_N, FP_BEFORE, FP_AFTER, """
chg AS (SELECT x.uid, CASE WHEN y.uid IS NULL THEN 'removed' WHEN x.digest <> y.digest THEN 'changed' END AS change
        FROM fp_b x LEFT JOIN fp_a y ON x.uid = y.uid)""", body="""
SELECT slide_uid % 100 AS patch_id, count(*) FILTER (change = 'changed') AS changed, 0::BIGINT AS added,
       count(*) FILTER (change = 'removed') AS removed
FROM blocks JOIN chg ON uid = block_uid WHERE change IS NOT NULL GROUP BY 1"""))
def apply_report(spark, sf):
    before, after, t = _fps(spark, sf)
    declared = t.blocks.select((F.col("slide_uid") % 100).alias("patch_id"), F.col("block_uid").alias("uid"))
    return ed.apply_report(ed.fingerprint_changes(before, after), declared)
