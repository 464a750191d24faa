"""Streams and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.operators import pages as pg
from briefloom.queries import base as b
from briefloom.queries.registry import ORACLES, query
from briefloom.sources import corpus as c
from briefloom.sources import exports as ex
from briefloom.streaming import edits as se


def edit_stream(spark, sf):
    """The edit log as a stream, projected as in batch."""
    schema = c.read(spark, sf, "events").schema
    e = se.log_stream(spark, sf, "events.parquet", schema)
    k = F.get_json_object("props", "$.k").cast("long")
    op = c._code(F.col("event_type"), c.EVENT_OPS)
    value = (F.when(op == "set_importance", F.round(F.col("value") * 2).cast("long").cast("string")).when(op == "pin", F.lit("true"))
             .when(op == "set_channel", c.pick(F.col("event_id") % 3, ["slide", "script", "drop"]))
             .when(op == "delete_block", F.lit("drop")).otherwise((300 + F.col("event_id") % 600).cast("string")))
    return e.select(F.col("user_id").alias("deck_uid"), F.col("event_id").alias("seq"), F.lit(1).alias("op_no"),
                    F.col("event_id").alias("patch_id"), F.col("ts").cast("timestamp").alias("created_at"), op.alias("op"),
                    k.alias("target"), value.alias("value"), "event_type", (F.col("event_id") % 100).alias("confidence_pct"))


@query("stream_latest", ORACLES["latest_values"])
def stream_latest(spark, sf):
    out = se.run_to_table(se.stream_latest_values(edit_stream(spark, sf)), "update", "latest")
    cols = ["value", "seq", "edits"]
    last = out.groupBy("deck_uid", "target", "field").agg(F.max_by(F.struct(*cols), "batch").alias("v"))
    return last.select("deck_uid", "target", "field", "v.*")


@query("stream_dedupe", "SELECT event_id AS patch_id, 1::BIGINT AS n FROM events")
def stream_dedupe(spark, sf):
    """Every fiftieth patch arrives twice and must count once."""
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("patch_id") % 50 == 0, 2).otherwise(1)))
    s = edit_stream(spark, sf).withColumn("copy", twice)
    out = se.run_to_table(se.stream_dedupe(s).select("patch_id"), "append", "dedupe")
    return out.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_undo_redo", b.with_("""ev AS (
  SELECT user_id AS deck_uid, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS control,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
walk AS (
  SELECT deck_uid, 0::BIGINT AS k, []::BIGINT[] AS ap, []::BIGINT[] AS un FROM (SELECT DISTINCT deck_uid FROM ev)
  UNION ALL
  SELECT w.deck_uid, e.k, CASE control WHEN 'edit' THEN list_append(ap, seq) WHEN 'undo' THEN ap[1:len(ap) - 1]
           ELSE CASE WHEN len(un) > 0 THEN list_append(ap, un[-1]) ELSE ap END END,
         CASE control WHEN 'edit' THEN [] WHEN 'undo' THEN CASE WHEN len(ap) > 0 THEN list_append(un, ap[-1]) ELSE un END ELSE un[1:len(un) - 1] END
  FROM walk w JOIN ev e ON e.deck_uid = w.deck_uid AND e.k = w.k + 1)""", recursive=True, body="""
SELECT deck_uid, unnest(ap) AS patch_id FROM (SELECT *, row_number() OVER (PARTITION BY deck_uid ORDER BY k DESC) AS r FROM walk) WHERE r = 1"""))
def stream_undo_redo(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    control = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    log = edit_stream(spark, sf).select("deck_uid", "seq", "patch_id", control.alias("control"))
    out = se.run_to_table(se.stream_fold(log), "append", "fold")
    return se.current_state(out).filter("state = 'applied'").select("deck_uid", "patch_id")


@query("stream_gate", """
SELECT CASE WHEN event_id % 100 >= 75 THEN 'apply' ELSE 'confirm' END AS decision, count(*) AS n FROM events GROUP BY 1""")
def stream_gate(spark, sf):
    out = se.shared_folder(spark, "gate")
    se.stream_gate(edit_stream(spark, sf), f"{out}/data", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("stream_validate", b.with_(b.BLOCKS, body="""
SELECT block_uid, 'UNSOURCED_CLAIM' AS code FROM blocks WHERE derivation <> 'authored' AND n_spans = 0 AND channel <> 'drop'
UNION ALL SELECT block_uid, 'VERBATIM_MULTISPAN' FROM blocks WHERE derivation = 'verbatim' AND n_spans > 1 AND asset_ref IS NULL
UNION ALL SELECT block_uid, 'SYNTHESIZED_SINGLE_SPAN' FROM blocks WHERE derivation = 'synthesized' AND n_spans < 2
UNION ALL SELECT block_uid, 'INFERRED_NOT_FLAGGED' FROM blocks WHERE derivation = 'inferred' AND NOT needs_confirmation"""))
def stream_validate(spark, sf):
    raw = se.log_stream(spark, sf, "lineitem.parquet", c.read(spark, sf, "lineitem").schema)
    out = se.run_to_table(se.stream_validate(c.blocks_of(raw)), "append", "validate")
    return out.select("block_uid", "code")


# --------------------------------------------------------------------- exports


def export_tables(spark, sf):
    t = c.deck_tables(spark, sf)
    s = pg.visible_order(t.slides).withColumn("title", F.concat(F.lit("S"), "slide_uid")).withColumn(
        "notes", F.when(F.col("slide_uid") % 6 == 0, F.concat(F.lit("note "), "slide_uid")))
    bl = c.numbered_blocks(t.blocks.select("slide_uid", "block_uid", "channel", *c.POSITION))
    bl = (bl.withColumn("content", F.concat(F.lit("c"), "part_key"))
          .withColumn("speaker_note", F.when(F.col("part_key") % 3 == 0, F.concat(F.lit("n"), "supp_key")))
          .withColumn("note_units", F.lit(1)).withColumn("unplaced", F.col("part_key") % 11 == 0))
    return t.decks.withColumn("title", F.concat(F.lit("D"), "deck_uid")), s, bl


EX = """ord AS (SELECT *, row_number() OVER (PARTITION BY deck_uid ORDER BY is_backup, section_no, slide_no) AS page_no,
               CASE WHEN slide_uid % 6 = 0 THEN 'note ' || slide_uid END AS notes FROM slides),
eb AS (SELECT *, 'c' || part_key AS content, CASE WHEN part_key % 3 = 0 THEN 'n' || supp_key END AS speaker_note FROM blocks)"""


@query("slide_notes", b.with_(b.SLIDES, b.BLOCKS, EX, body="""
SELECT slide_uid, 0 AS part, 0::BIGINT AS no, notes AS text FROM ord WHERE notes IS NOT NULL
UNION ALL SELECT slide_uid, 0, CASE WHEN notes IS NULL THEN 0 ELSE 1 END, '[20s]' FROM ord WHERE dwell_seconds > 0
UNION ALL SELECT slide_uid, 1, block_no, content FROM eb WHERE channel = 'script'
UNION ALL SELECT slide_uid, 1, block_no, speaker_note FROM eb WHERE channel = 'slide' AND speaker_note IS NOT NULL
UNION ALL SELECT slide_uid, 2, block_no, '[未能放入版式] ' || content FROM eb WHERE part_key % 11 = 0"""))
def slide_notes(spark, sf):
    _, s, bl = export_tables(spark, sf)
    return ex.slide_notes(s, bl)


@query("script_export", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, EX, """
live AS (SELECT * FROM ord WHERE NOT is_backup),
lb AS (SELECT eb.*, deck_uid, page_no, notes FROM eb JOIN live USING (slide_uid) WHERE channel <> 'drop'),
per AS (SELECT deck_uid, page_no, count(*) FILTER (channel = 'script' OR speaker_note IS NOT NULL) AS said,
               sum(CASE WHEN channel = 'script' THEN units WHEN speaker_note IS NOT NULL THEN 1 END) AS words, bool_or(notes IS NOT NULL) AS noted
        FROM lb GROUP BY ALL)""", body="""
SELECT deck_uid, 0::BIGINT AS page_no, 0 AS part, 0::BIGINT AS no, '# D' || deck_uid AS text FROM decks
UNION ALL SELECT deck_uid, 0, 1, 0, '*目标时长 ' || total_seconds // 60 || ' 分 ' || total_seconds % 60 || ' 秒 · 语速 210/分 · 密度 ' || density || '*' FROM decks
UNION ALL SELECT deck_uid, page_no, 0, 0, '## ' || page_no || '. S' || slide_uid || CASE WHEN dwell_seconds > 0 THEN '  (20s)' ELSE '' END FROM live
UNION ALL SELECT deck_uid, page_no, 1, 0, notes FROM live WHERE notes IS NOT NULL
UNION ALL SELECT deck_uid, page_no, 2, block_no, CASE WHEN channel = 'script' THEN content ELSE speaker_note END FROM lb WHERE channel = 'script' OR speaker_note IS NOT NULL
UNION ALL SELECT lb.deck_uid, lb.page_no, 3, block_no, '- ' || content FROM lb JOIN per USING (deck_uid, page_no) WHERE said = 0 AND NOT noted AND channel = 'slide'
UNION ALL SELECT deck_uid, page_no, 4, 0, '*约 ' || words || ' 字 / ' || CAST(round_even(words * 60 / 210.0, 0) AS BIGINT) || 's*' FROM per WHERE words > 0
UNION ALL SELECT deck_uid, 1099511627776, 5, slide_no, '- S' || slide_uid FROM ord WHERE is_backup"""))
def script_export(spark, sf):
    return ex.script_lines(*export_tables(spark, sf))


@query("anchors_json")
def anchors_json(spark, sf):
    """Compact anchor records; number formatting is engine-specific, so rows only."""
    return ex.anchors_to_json(c.anchors(spark, sf))


@query("run_metrics", b.with_(b.SLIDES, b.DECKS, b.BLOCKS, """
u AS (SELECT deck_uid, sum(units) AS units FROM blocks JOIN slides USING (slide_uid) WHERE NOT is_backup AND channel <> 'drop' GROUP BY deck_uid),
s AS (SELECT deck_uid, count(*) FILTER (NOT is_backup) AS actual FROM slides GROUP BY deck_uid)""", body="""
SELECT deck_uid, total_seconds * 900 * wpm // 60000 AS total_units, greatest(1, CAST(round_even(total_seconds * 900 / 45000.0, 0) AS BIGINT)) AS target_slides,
       coalesce(actual, 0) AS actual_slides, round(coalesce(units, 0) * 60 / 210.0 / total_seconds, 4)::DOUBLE AS fit
FROM decks LEFT JOIN u USING (deck_uid) LEFT JOIN s USING (deck_uid)"""))
def run_metrics(spark, sf):
    from briefloom.plans import metrics

    t = c.deck_tables(spark, sf)
    return metrics.run_metrics(t.decks, t.slides, t.blocks)
