"""Scripts, notes and anchor files as rows, ready to be written in order by many tasks.

A script is emitted as numbered lines rather than one string per deck, so a deck of any length is written by as many
tasks as its lines need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import latex as lx


def slide_notes(slides: DataFrame, blocks: DataFrame, escape: bool = False) -> DataFrame:
    """Narration parts of each slide in order: notes, time, then script text and speaker notes, then what had no room.

    ``blocks``: with block_no, content, channel, speaker_note, unplaced (boolean).
    """
    def clean(c: Column) -> Column:
        return lx.escape_latex(c) if escape else c

    head = slides.select("slide_uid", F.posexplode(F.array_compact(F.array(
        F.nullif(clean(F.col("notes")), F.lit("")),
        F.when(F.col("dwell_seconds") > 0, F.concat(F.lit("["), F.bround("dwell_seconds", 0).cast("long"), F.lit("s]")))))
    ).alias("k", "text")).select("slide_uid", F.lit(0).alias("part"), F.col("k").cast("long").alias("no"), "text")
    said = (F.when(F.col("channel") == "script", F.col("content"))
            .when((F.col("channel") == "slide") & (F.coalesce("speaker_note", F.lit("")) != ""), F.col("speaker_note")))
    body = blocks.select("slide_uid", F.lit(1).alias("part"), F.col("block_no").cast("long").alias("no"), clean(said).alias("text"))
    left = blocks.filter("unplaced").select("slide_uid", F.lit(2).alias("part"), F.col("block_no").cast("long").alias("no"), F.concat(
        F.lit("[未能放入版式] "), F.coalesce(F.nullif("content", F.lit("")), "block_uid")).alias("text"))
    return head.unionByName(body.filter("text <> ''")).unionByName(left)


def script_lines(decks: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """The speaker script as lines: (deck_uid, page_no, part, no, text).

    ``slides``: with page_no (position among presented slides; null for reserve), title, notes, dwell_seconds.
    ``blocks``: with units and note_units. Slides with nothing to say list their points instead.
    """
    def line(df: DataFrame, page: Column, part: int, no: Column, text: Column) -> DataFrame:
        return df.select("deck_uid", page.cast("long").alias("page_no"), F.lit(part).alias("part"), no.cast("long").alias("no"),
                         text.alias("text"))

    zero = F.lit(0)
    m = F.floor(F.col("total_seconds") / 60)
    top = line(decks, zero, 0, zero, F.concat(F.lit("# "), "title")).unionByName(line(decks, zero, 1, zero, F.concat(
        F.lit("*目标时长 "), m, F.lit(" 分 "), F.col("total_seconds") % 60, F.lit(" 秒 · 语速 "), F.col("words_per_minute"),
        F.lit("/分 · 密度 "), F.col("density"), F.lit("*"))))
    live = slides.filter("NOT is_backup")
    time = F.when(F.col("dwell_seconds") > 0, F.concat(F.lit("  ("), F.bround("dwell_seconds", 0).cast("long"), F.lit("s)"))).otherwise("")
    heads = line(live, F.col("page_no"), 0, zero, F.concat(F.lit("## "), "page_no", F.lit(". "), "title", time))
    note = line(live.filter("notes <> ''"), F.col("page_no"), 1, zero, F.col("notes"))
    b = blocks.filter("channel <> 'drop'").join(live.select("slide_uid", "deck_uid", "page_no", "notes"), "slide_uid")
    script = F.col("channel") == "script"
    own_note = F.coalesce("speaker_note", F.lit("")) != ""
    spoken = line(b.filter(script | own_note), F.col("page_no"), 2, F.col("block_no"),
                  F.when(script, F.col("content")).otherwise(F.col("speaker_note")))
    per = b.groupBy("deck_uid", "page_no").agg(
        F.count_if(script | own_note).alias("said"), F.sum(F.when(script, F.col("units")).when(own_note, F.col("note_units"))).alias("words"),
        F.max(F.coalesce("notes", F.lit("")) != "").alias("noted"))
    silent = per.filter("said = 0 AND NOT noted").select("deck_uid", "page_no")
    shown = b.filter("channel = 'slide' AND content <> ''").join(silent, ["deck_uid", "page_no"], "left_semi")
    points = line(shown, F.col("page_no"), 3, F.col("block_no"), F.concat(F.lit("- "), "content"))
    count = per.filter("words > 0").join(decks.select("deck_uid", "words_per_minute"), "deck_uid")
    total = line(count, F.col("page_no"), 4, zero, F.concat(F.lit("*约 "), "words", F.lit(" 字 / "), F.bround(
        F.col("words") * 60 / F.col("words_per_minute"), 0).cast("long"), F.lit("s*")))
    last = F.lit(2 ** 40)
    reserve = line(slides.filter("is_backup"), last, 5, F.col("slide_no"), F.concat(F.lit("- "), "title"))
    out = top
    for part in (heads, note, spoken, points, total, reserve):
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered text files: range-partitioned by deck and position, sorted inside."""
    order = ["deck_uid", "page_no", "part", "no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


def anchors_to_json(anchors: DataFrame) -> DataFrame:
    """One compact record per anchor; a reader groups them by deck and page."""
    box = F.array(*[F.round(n, 5) for n in ("x", "y", "w", "h")])
    rec = F.struct("uid", "kind", F.col("slide_index").alias("slide"), box.alias("box"), F.round("confidence", 3).alias("confidence"))
    return anchors.select("deck_uid", "slide_index", "uid", F.to_json(rec).alias("json"))
